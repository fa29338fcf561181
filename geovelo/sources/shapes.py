"""Polygon files in the shapefile format, split by the offsets of their records."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: its mark, the size of its header, and the kinds of shapes
_MARK, _HEADER, _NOTHING, _POLYGONS = 9994, 100, 0, (5, 15, 25)
#: Bytes of shapes in one partition, unless a single shape has more.
SPLIT = 16 << 20
_NAMES = ["key", "feature_ord", "x1", "y1", "x2", "y2"]
_SCHEMA = "key string, feature_ord int, x1 double, y1 double, x2 double, y2 double"


@dataclass
class _Records(InputPartition):
    """Shapes first to last - 1, which stand in the bytes from start to end."""

    first: int
    last: int
    start: int
    end: int


def _beside(path: str, ending: str) -> str:
    stem = os.path.splitext(path)[0]
    return stem + ending if os.path.exists(stem + ending) or not os.path.exists(stem + ending.upper()) else stem + ending.upper()


def _offsets(path: str) -> np.ndarray:
    """(shape, 2): where each shape's record begins, and the bytes of its content, from the index file."""
    with open(_beside(path, ".shx"), "rb") as f:
        head = f.read(_HEADER)
        if len(head) < _HEADER or struct.unpack(">i", head[:4])[0] != _MARK:
            raise ValueError(f"no index of shapes beside {path}")
        return np.frombuffer(f.read(), ">i4").reshape(-1, 2).astype(np.int64) * 2


def _field(path: str, name: str) -> tuple[int, int, int, int]:
    """(bytes before the first row, bytes of a row, where the named field begins in it, its bytes), from the attribute file."""
    with open(_beside(path, ".dbf"), "rb") as f:
        head = f.read(32)
        before, row = struct.unpack("<HH", head[8:12])
        at = 1  # after the mark of deleted rows
        while (field := f.read(32)) and field[:1] != b"\r":
            if field[:11].split(b"\0")[0].decode("latin-1") == name:
                return before, row, at, field[16]
            at += field[16]
    raise KeyError(f"no field {name} beside {path}")


def _sides(content: bytes) -> np.ndarray:
    """(side, 4): x1, y1, x2, y2 of all rings of a polygon."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == _NOTHING:
        return np.empty((0, 4))
    if kind not in _POLYGONS:
        raise ValueError(f"shapes of kind {kind}, not polygons")
    n_rings, n_points = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_rings, 44).tolist()
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_rings).reshape(-1, 2)
    rings = [points[a:b] for a, b in zip(starts, [*starts[1:], n_points])]
    return np.concatenate([np.empty((0, 4)), *[np.hstack((r, np.roll(r, -1, axis=0)))[: -1 if len(r) > 1 and (r[0] == r[-1]).all() else None] for r in rings]])


class _ShapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name, self.split = options["path"].removeprefix("file://").removeprefix("file:"), options["field"], int(options["split"])

    def partitions(self) -> list[_Records]:
        at = _offsets(self.path)
        ends = at[:, 0] + 8 + at[:, 1]
        found, first = [], 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, at[first, 0] + self.split, side="right")))
            found.append(_Records(first, last, int(at[first, 0]), int(ends[last - 1])))
            first = last
        return found

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        at = _offsets(self.path)[partition.first : partition.last]
        before, row, begin, size = _field(self.path, self.name)
        with open(_beside(self.path, ".dbf"), "rb") as f:
            f.seek(before + partition.first * row)
            attributes = f.read(len(at) * row)
        with open(self.path, "rb") as f:
            for k, (start, length) in enumerate(at.tolist()):
                f.seek(start + 8)
                sides = _sides(f.read(length))
                key = attributes[k * row + begin : k * row + begin + size].decode("latin-1").strip()
                n = len(sides)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([partition.first + k] * n, pa.int32()), *[pa.array(sides[:, j].copy()) for j in range(4)]], _NAMES)


class ShapeSource(DataSource):
    """Source of read_shapes."""

    @classmethod
    def name(cls) -> str:
        return "geovelo_shapes"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShapeReader(self.options)


def read_shapes(spark: SparkSession, path: str, field: str = "gid", split: int = SPLIT) -> DataFrame:
    """(gid, feature_ord, x1, y1, x2, y2): the sides of all rings of the polygons in a shapefile; gid is the attribute named field, feature_ord a polygon's place in the file.

    Tasks take stretches of records of about split bytes. Null shapes have no sides, rings that are left open are closed, sides without length are left out, gids that are no numbers are null. The file, with its index
    (.shx) and attributes (.dbf) beside it, is in a folder that the driver and all executors see.
    """
    spark.dataSource.register(ShapeSource)
    told = spark.read.format("geovelo_shapes").option("field", field).option("split", split).load(path)
    return told.where("x1 != x2 OR y1 != y2").select(F.col("key").try_cast("double").try_cast("int").alias("gid"), "feature_ord", "x1", "y1", "x2", "y2")
