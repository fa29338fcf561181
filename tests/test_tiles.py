"""Rasters as GeoTIFF blocks: round trips, windows, what is left after a failure."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geovelo.operators.raster import Grid
from geovelo.sources import tiles

GRID = Grid(1_500_000.0, 5_300_000.0, 100.0, -100.0, 70, 45)


def _raster(spark):
    row, col = F.floor(F.col("id") / GRID.nx).cast("int"), (F.col("id") % GRID.nx).cast("int")
    value = F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 977) / 4.0)
    return spark.range(GRID.nx * GRID.ny).where("id % 13 != 0").select(row.alias("row"), col.alias("col"), value.alias("vs30"), F.when(F.col("id") % 7 != 0, F.col("id") / 8.0).alias("stdv"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _key(r):
    return (r[0], r[1])


def test_round_trip_and_window(spark, tmp_path):
    path = str(tmp_path / "vs30")
    tiles.write_tiles(_raster(spark), GRID, path, block=32)
    want = {_key(r): r[2:] for r in _raster(spark).where("vs30 IS NOT NULL OR stdv IS NOT NULL").collect()}
    assert {_key(r): r[2:] for r in tiles.read_tiles(spark, path, block=32).collect()} == want
    part = tiles.read_tiles(spark, path, block=32, rows=(33, 44), cols=(0, 40))
    assert {_key(r): r[2:] for r in part.collect()} == {k: v for k, v in want.items() if k[0] >= 33 and k[1] <= 40}
    # the blocks that the window doesn't meet may be broken without harm
    for r, c in ((0, 0), (0, 1), (0, 2), (1, 2)):
        with open(f"{path}/row_block={r}/col_block={c}/block.tif", "wb") as f:
            f.write(b"no raster")
    assert part.count() and tiles.read_tiles(spark, path, block=32, rows=(33, 44), cols=(0, 40)).count() == part.count()
    with pytest.raises(Exception, match="not a TIFF"):
        tiles.read_tiles(spark, path, block=32).count()
    text = open(f"{path}/mosaic.vrt").read()
    assert text.count("<ComplexSource>") == 2 * 6 and 'rasterXSize="70"' in text


def test_a_failed_write_leaves_nothing_and_a_full_folder_stays(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = _raster(spark).withColumn("vs30", F.when(F.col("row") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("vs30")))
    with pytest.raises(Exception, match="lost"):
        tiles.write_tiles(bad, GRID, path, block=32)
    assert not os.path.exists(path) and not os.listdir(tmp_path)
    tiles.write_tiles(_raster(spark), GRID, path, block=32)
    before = _rows(tiles.read_tiles(spark, path, block=32).fillna(-1))
    with pytest.raises(FileExistsError):
        tiles.write_tiles(_raster(spark), GRID, path, block=32)
    with pytest.raises(Exception, match="lost"):
        tiles.write_tiles(bad, GRID, path, block=32, overwrite=True)
    assert _rows(tiles.read_tiles(spark, path, block=32).fillna(-1)) == before
    tiles.write_tiles(_raster(spark).where("row < 10"), GRID, path, block=32, overwrite=True)
    assert {r.row for r in tiles.read_tiles(spark, path, block=32).collect()} == set(range(10)) and os.listdir(tmp_path) == ["out"]


def test_blocks_are_geotiffs():
    bands = np.arange(2 * 5 * 7, dtype=float).reshape(2, 5, 7)
    bands[0, 1, 1] = np.nan
    data = tiles.encode(bands, 10.0, 20.0, 2.0, -3.0)
    told, place = tiles.decode(data)
    assert np.array_equal(told, bands, equal_nan=True) and place == (10.0, 20.0, 2.0, -3.0)
    assert data[:4] == b"II*\0" and b"-32767\0" in data


def _tiff(order, fields, blob):
    """A TIFF of single-value fields and a blob at 8."""
    at = 8 + len(blob)
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + blob + struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + ("I" if k == 4 else "HH"), *((v,) if k == 4 else (v, 0))) for t, k, v in sorted(fields)) + struct.pack(order + "I", 0)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_strips_of_other_writers(order, packed):
    image = np.arange(12, dtype=order + "i2").reshape(3, 4)
    blob = image.tobytes()
    blob = zlib.compress(blob) if packed else blob
    fields = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 8 if packed else 1), (273, 4, 8), (277, 3, 1), (278, 4, 3), (279, 4, len(blob)), (339, 3, 2)]
    assert np.array_equal(tiles.decode(_tiff(order, fields, blob))[0][0], image)
    with pytest.raises(ValueError, match="predictor"):
        tiles.decode(_tiff(order, [*fields, (317, 3, 2)], blob))
