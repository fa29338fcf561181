"""Rasters as folders of GeoTIFF blocks under a mosaic file, which map software reads as one raster.

Blocks lie in folders row_block=R/col_block=C, so a window is a filter on partition columns and only its blocks' files are opened. They are
read by Spark's own file reader, from any store that it reaches; to be written they need a folder that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.raster import Grid

NO_DATA = -32767.0
BLOCK = 512
# TIFF's tags, sizes of its field types, and the code of the projection
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _EXTRA, _FORMAT, _SCALE, _TIE, _KEYS, _GDAL_NODATA = 322, 323, 324, 325, 338, 339, 33550, 33922, 34735, 42113
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_CODES = {"short": 3, "long": 4, "double": 12, "text": 2}
_NZTM = 2193


def encode(bands: np.ndarray, x0: float, y0: float, dx: float, dy: float) -> bytes:
    """bands (band, row, col) as a little-endian GeoTIFF of deflated 32-bit floats, one tile a band; NaN becomes NO_DATA. dy is negative where rows run south."""
    count, rows, cols = bands.shape
    high, wide = -(-rows // 16) * 16, -(-cols // 16) * 16
    padded = np.full((count, high, wide), NO_DATA, "<f4")
    padded[:, :rows, :cols] = np.where(np.isnan(bands), NO_DATA, bands)
    tiles = [zlib.compress(x.tobytes(), 6) for x in padded]
    starts = np.cumsum([8, *map(len, tiles)]).tolist()
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, _NZTM]
    fields = {
        _WIDTH: ("long", [cols]), _HEIGHT: ("long", [rows]), _BITS: ("short", [32] * count), _COMPRESSION: ("short", [8]), _PHOTOMETRIC: ("short", [1]), _SAMPLES: ("short", [count]), _PLANAR: ("short", [2]),
        _TILE_WIDTH: ("long", [wide]), _TILE_HEIGHT: ("long", [high]), _TILES: ("long", starts[:-1]), _TILE_BYTES: ("long", [len(t) for t in tiles]), _FORMAT: ("short", [3] * count),
        _SCALE: ("double", [dx, -dy, 0.0]), _TIE: ("double", [0.0, 0.0, 0.0, x0, y0, 0.0]), _KEYS: ("short", keys), _GDAL_NODATA: ("text", f"{NO_DATA:g}\0".encode()),
    } | ({_EXTRA: ("short", [0] * (count - 1))} if count > 1 else {})
    told, end = [], starts[-1] + starts[-1] % 2
    directory, beside = b"", b""
    first = end + 2 + 12 * len(fields) + 4
    for tag in sorted(fields):
        kind, values = fields[tag]
        raw = values if kind == "text" else struct.pack(f"<{len(values)}{_SIZES[_CODES[kind]]}", *values)
        told.append(struct.pack("<HHI", tag, _CODES[kind], len(values)))
        if len(raw) <= 4:
            directory += told[-1] + raw.ljust(4, b"\0")
        else:
            directory += told[-1] + struct.pack("<I", first + len(beside))
            beside += raw + b"\0" * (len(raw) % 2)
    return b"".join([struct.pack("<2sHI", b"II", 42, end), *tiles, b"\0" * (starts[-1] % 2), struct.pack("<H", len(fields)), directory, struct.pack("<I", 0), beside])


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """(bands, (x0, y0, dx, dy)) of a TIFF's first image: strips or tiles, plain or deflated, of whole numbers or floats; NaN where there is no data. Other kinds are an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    fields: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _SIZES:
            continue
        form = f"{order}{n}{_SIZES[kind]}"
        where = at + 10 + 12 * k
        fields[tag] = struct.unpack_from(form, data, where if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, where)[0])
    one = lambda tag, default: fields.get(tag, (default,))[0]
    cols, rows, count, planar = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1), one(_PLANAR, 1)
    if one(_COMPRESSION, 1) not in (1, 8, 32946) or one(_PREDICTOR, 1) != 1:
        raise ValueError("only plain and deflated TIFF files without predictor")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(_FORMAT, 1)] + str(one(_BITS, 8) // 8))
    wide, high, starts, sizes = (one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0), fields[_TILES], fields[_TILE_BYTES]) if _TILES in fields else (cols, min(one(_STRIP_ROWS, rows), rows), fields[_STRIPS], fields[_STRIP_BYTES])
    across, down, depth = -(-cols // wide), -(-rows // high), count if planar == 1 else 1
    out = np.empty((count, down * high, across * wide), dtype)
    for k, (start, size) in enumerate(zip(starts, sizes)):
        raw = data[start : start + size]
        part = np.frombuffer(raw if one(_COMPRESSION, 1) == 1 else zlib.decompress(raw), dtype)
        band, place = divmod(k, across * down)
        r, c = divmod(place, across)
        part = part.reshape(-1, wide, depth)
        out[band : band + depth, r * high : r * high + len(part), c * wide : (c + 1) * wide] = np.moveaxis(part, 2, 0)
    found = out[:, :rows, :cols].astype(float)
    if _GDAL_NODATA in fields:
        found[found == float(fields[_GDAL_NODATA][0].strip(b"\0 "))] = np.nan
    scale, tie = fields.get(_SCALE, (1.0, 1.0, 0.0)), fields.get(_TIE, (0.0,) * 6)
    return found, (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1])


def _mosaic(grid: Grid, block: int, names: Sequence[str], held: Sequence[tuple[int, int]]) -> str:
    """The virtual raster over all blocks, as text."""
    bands = []
    for k, name in enumerate(names, 1):
        each = []
        for r, c in held:
            wide, high = min(block, grid.nx - c * block), min(block, grid.ny - r * block)
            source, target = f'<SrcRect xOff="0" yOff="0" xSize="{wide}" ySize="{high}"/>', f'<DstRect xOff="{c * block}" yOff="{r * block}" xSize="{wide}" ySize="{high}"/>'
            each.append(f'<ComplexSource><SourceFilename relativeToVRT="1">row_block={r}/col_block={c}/block.tif</SourceFilename><SourceBand>{k}</SourceBand>{source}{target}<NODATA>{NO_DATA:g}</NODATA></ComplexSource>')
        bands.append(f'<VRTRasterBand dataType="Float32" band="{k}"><Description>{name}</Description><NoDataValue>{NO_DATA:g}</NoDataValue>{"".join(each)}</VRTRasterBand>')
    return f'<VRTDataset rasterXSize="{grid.nx}" rasterYSize="{grid.ny}"><SRS>EPSG:{_NZTM}</SRS><GeoTransform>{grid.x0}, {grid.dx}, 0, {grid.y0}, 0, {grid.dy}</GeoTransform>{"".join(bands)}</VRTDataset>'


@dataclass
class _Held(WriterCommitMessage):
    """Blocks that a task has written: (row block, column block, file)."""

    blocks: list[tuple[int, int, str]]


class _BlockWriter(DataSourceArrowWriter):
    """Rows come sorted by block, so a task holds one block at a time. Files are moved to their places when all tasks are done."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.grid, self.block, self.names, self.overwrite = options["path"].removeprefix("file://").removeprefix("file:"), Grid(**json.loads(options["grid"])), int(options["block"]), names, overwrite
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def _flush(self, key: tuple[int, int], parts: list[pa.RecordBatch]) -> tuple[int, int, str]:
        g, (r, c) = self.grid, key
        r0, c0 = r * self.block, c * self.block
        bands = np.full((len(self.names), min(self.block, g.ny - r0), min(self.block, g.nx - c0)), np.nan)
        for part in parts:
            at = part.column("row").to_numpy() - r0, part.column("col").to_numpy() - c0
            for k, name in enumerate(self.names):
                bands[(k, *at)] = part.column(name).to_numpy(zero_copy_only=False).astype(float)
        os.makedirs(self.staged, exist_ok=True)
        name = f"{self.staged}/{r}-{c}-{uuid.uuid4().hex}"
        with open(name, "wb") as f:
            f.write(encode(bands, g.x0 + c0 * g.dx, g.y0 + r0 * g.dy, g.dx, g.dy))
        return r, c, name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Held:
        held, key, parts = [], None, []
        for batch in iterator:
            if not batch.num_rows:
                continue
            r, c = (batch.column(n).to_numpy() for n in ("row_block", "col_block"))
            cuts = [0, *(np.flatnonzero((np.diff(r) != 0) | (np.diff(c) != 0)) + 1).tolist(), len(r)]
            for lo, hi in zip(cuts, cuts[1:]):
                own = (int(r[lo]), int(c[lo]))
                if own != key and parts:
                    held.append(self._flush(key, parts))
                    parts = []
                key = own
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            held.append(self._flush(key, parts))
        return _Held(held)

    def commit(self, messages: list[_Held]) -> None:
        os.makedirs(self.staged, exist_ok=True)
        whole = f"{self.staged}/whole"
        held = sorted((r, c, f) for m in messages if m is not None for r, c, f in m.blocks)
        os.makedirs(whole)
        for r, c, f in held:
            os.makedirs(f"{whole}/row_block={r}/col_block={c}", exist_ok=True)
            os.replace(f, f"{whole}/row_block={r}/col_block={c}/block.tif")
        with open(f"{whole}/mosaic.vrt", "w") as f:
            f.write(_mosaic(self.grid, self.block, self.names, [(r, c) for r, c, _ in held]))
        # a dot keeps Spark's readers from it
        with open(f"{whole}/.raster.json", "w") as f:
            json.dump({"grid": asdict(self.grid), "block": self.block, "bands": self.names}, f)
        old = f"{self.staged}/old"
        if os.path.exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            os.rename(self.path, old)
        os.rename(whole, self.path)
        shutil.rmtree(self.staged)

    def abort(self, messages: list[_Held]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class BlockSink(DataSource):
    """Sink of write_tiles."""

    @classmethod
    def name(cls) -> str:
        return "geovelo_blocks"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BlockWriter(self.options, [f.name for f in schema if f.name not in ("row", "col", "row_block", "col_block")], overwrite)


def write_tiles(raster: DataFrame, grid: Grid, path: str, block: int = BLOCK, overwrite: bool = False) -> None:
    """raster (row, col and one column a band) as GeoTIFF blocks of block x block pixels and mosaic.vrt over them. Nulls, missing pixels of a block and pixels off the grid hold no data; blocks without pixels have no file.

    Either all of it is there at the end or nothing. path is in a folder that the driver and all executors share.
    """
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.exists(local) and not overwrite:
        raise FileExistsError(path)
    spark = raster.sparkSession
    spark.dataSource.register(BlockSink)
    bands = [c for c in raster.columns if c not in ("row", "col")]
    inside = raster.where(F.col("row").between(0, grid.ny - 1) & F.col("col").between(0, grid.nx - 1))
    keyed = inside.select(F.floor(F.col("row") / block).cast("int").alias("row_block"), F.floor(F.col("col") / block).cast("int").alias("col_block"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("double").alias(c) for c in bands])
    sorted_blocks = keyed.repartition("row_block", "col_block").sortWithinPartitions("row_block", "col_block")
    sorted_blocks.write.format("geovelo_blocks").option("grid", json.dumps(asdict(grid))).option("block", block).mode("overwrite" if overwrite else "append").save(path)


def read_tiles(spark: SparkSession, path: str, bands: Sequence[str] = ("vs30", "stdv"), block: int = BLOCK, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """(row, col and one column a band) of the pixels that hold data in any band; rows and cols name the first and last row and column of a window, and only its blocks' files are opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("content", F.col("row_block").cast("int").alias("row_block"), F.col("col_block").cast("int").alias("col_block"))
    for name, window in (("row", rows), ("col", cols)):
        if window is not None:
            found = found.where(F.col(f"{name}_block").between(window[0] // block, window[1] // block))
    names = list(bands)

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, r, c = (batch.column(j)[k].as_py() for j in range(3))
                told = decode(data)[0]
                if len(told) != len(names):
                    raise ValueError(f"{len(told)} bands, not {len(names)}")
                at = np.nonzero(~np.isnan(told).all(axis=0))
                values = [pa.array(x[at], mask=np.isnan(x[at])) for x in told]
                yield pa.RecordBatch.from_arrays([pa.array((at[0] + r * block).astype(np.int32)), pa.array((at[1] + c * block).astype(np.int32)), *values], ["row", "col", *names])

    out = found.mapInArrow(pixels, "row int, col int, " + ", ".join(f"`{n}` double" for n in names))
    for name, window in (("row", rows), ("col", cols)):
        if window is not None:
            out = out.where(F.col(name).between(*window))
    return out
