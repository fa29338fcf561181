"""Rasters as tables of pixels (row, col, value) under a grid."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .spatial import in_polygons

#: Pixels of a block that a task of the distance transform works on.
BLOCK = 1 << 17


@dataclass(frozen=True)
class Grid:
    """x0, y0: the corner at row 0, column 0; dy is negative where rows run south."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int

    @classmethod
    def over(cls, xmin: float, xmax: float, ymin: float, ymax: float, dx: float, dy: float) -> Grid:
        """Rows run south from ymax; the numbers of rows and columns are rounded."""
        return cls(xmin, ymax, dx, -dy, round((xmax - xmin) / dx), round((ymax - ymin) / dy))

    def covering(self, xmin: float, xmax: float, ymin: float, ymax: float) -> Grid:
        """The grid grown outward by whole cells until it covers the box."""
        left = max(0, math.ceil((self.x0 - xmin) / self.dx))
        up = max(0, math.ceil((ymax - self.y0) / -self.dy))
        right = max(0, math.ceil((xmax - self.x0) / self.dx) - self.nx)
        down = max(0, math.ceil((self.y0 - ymin) / -self.dy) - self.ny)
        return Grid(self.x0 - left * self.dx, self.y0 - up * self.dy, self.dx, self.dy, self.nx + left + right, self.ny + up + down)


def pixels(spark: SparkSession, grid: Grid) -> DataFrame:
    """(point_id, row, col, easting, northing): pixel centres, made on the executors."""
    row, col = F.floor(F.col("id") / grid.nx).cast("int"), (F.col("id") % grid.nx).cast("int")
    cells = spark.range(grid.nx * grid.ny).select(F.col("id").alias("point_id"), row.alias("row"), col.alias("col"))
    return cells.withColumns({"easting": grid.x0 + (F.col("col") + 0.5) * grid.dx, "northing": grid.y0 + (F.col("row") + 0.5) * grid.dy})


def stacked(rasters: dict[str, DataFrame]) -> DataFrame:
    """(row, col and one column a raster): rasters (row, col, value) of one grid side by side, null where one has no pixel."""
    rows = reduce(DataFrame.unionAll, [r.select("row", "col", F.lit(k).alias("_k"), F.col("value").cast("double").alias("_v")) for k, r in enumerate(rasters.values())])
    return rows.groupBy("row", "col").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(name) for k, name in enumerate(rasters)])


def lookup(points: DataFrame, raster: DataFrame, grid: Grid, name: str) -> DataFrame:
    """points plus the value of the pixel that they lie in, null outside the grid and where the raster has no pixel."""
    return lookup_all(points, raster.select("row", "col", F.col("value").alias(name)), grid)


def lookup_all(points: DataFrame, pixels: DataFrame, grid: Grid) -> DataFrame:
    """points plus all other columns of pixels (row, col, ..) by the pixel that they lie in."""
    col, row = F.floor((F.col("easting") - grid.x0) / grid.dx), F.floor((F.col("northing") - grid.y0) / grid.dy)
    inside = (col >= 0) & (col < grid.nx) & (row >= 0) & (row < grid.ny)
    # rows outside get negative keys of many values: they meet no pixel, and not each other in one task either
    apart = -1 - F.pmod(F.xxhash64("easting", "northing", *[c for c in ("point_id", "site_id") if c in points.columns]), F.lit(4096))
    placed = points.withColumns({"_row": F.when(inside, row).otherwise(apart).cast("int"), "_col": F.when(inside, col).cast("int")}).fillna(-1, ["_col"])
    return placed.join(pixels.withColumnsRenamed({"row": "_row", "col": "_col"}), ["_row", "_col"], "left").drop("_row", "_col")


def no_data(raster: DataFrame, value: float) -> DataFrame:
    """A raster whose pixels of that value are null."""
    return raster.withColumn("value", F.nullif(F.col("value"), F.lit(value)))


def resample(raster: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """(row, col, value) on the target grid: nearest neighbour, the source pixel under the target's centre."""
    return lookup(pixels(raster.sparkSession, target), raster, source, "value").select("row", "col", "value")


def rasterise(edges: DataFrame, grid: Grid, cell: float) -> DataFrame:
    """(row, col, value): gid of the polygon over each pixel centre, the last feature winning; null outside."""
    return in_polygons(pixels(edges.sparkSession, grid), edges, cell, last=True).select("row", "col", F.col("gid").alias("value"))


def _envelope(gap: np.ndarray, ratio: float) -> np.ndarray:
    """Squared distances to the nearest of each row's sources: the least over columns j of gap[.., j] + (ratio * (i - j)) ** 2; gap is infinite where there is none.

    All rows advance together from column to column, each with its stack of parabolas that are lowest somewhere: a new one pops those that
    it hides, so every column is pushed and popped once at most.
    """
    rows, cols = gap.shape
    place, start, top = np.zeros((rows, cols), np.int32), np.zeros((rows, cols)), np.full(rows, -1)
    height = gap + (ratio * np.arange(cols)) ** 2
    for j in range(cols):
        new = np.flatnonzero(np.isfinite(gap[:, j]))
        left, begins = new, np.zeros(len(new))
        asked = np.arange(len(new))
        while len(left):
            some = top[left] >= 0
            left, asked = left[some], asked[some]
            if not len(left):
                break
            under = place[left, top[left]]
            cross = (height[left, j] - height[left, under]) / (2 * ratio * ratio * (j - under))
            hidden = cross <= start[left, top[left]]
            begins[asked[~hidden]] = cross[~hidden]
            top[left[hidden]] -= 1
            left, asked = left[hidden], asked[hidden]
        # the first parabola of a row holds from its left end on
        begins = np.where(top[new] >= 0, begins, -1.0)
        top[new] += 1
        place[new, top[new]], start[new, top[new]] = j, begins
    # parabola k holds from its start on: the number of starts up to a column names the one that holds there
    k = np.arange(cols)
    counted = np.zeros((rows, cols + 1), np.int32)
    r, c = np.nonzero((k[None, :] <= top[:, None]) & (k[None, :] > 0))
    np.add.at(counted, (r, np.clip(np.ceil(start[r, c]), 0, cols).astype(int)), 1)
    lowest = np.take_along_axis(place, np.cumsum(counted[:, :cols], axis=1), axis=1)
    squared = np.take_along_axis(gap, lowest, axis=1) + (ratio * (k[None, :] - lowest)) ** 2
    return np.where(top[:, None] >= 0, squared, np.inf)


def _gaps(r: np.ndarray, c: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Rows from each place of rows x cols to the nearest source in its column. Sources may lie above row 0 and below the last one."""
    inside = (r >= 0) & (r < rows)
    above, below = np.full((rows + 1, cols), -np.inf), np.full((rows + 1, cols), np.inf)
    above[r[inside] + 1, c[inside]] = below[r[inside], c[inside]] = r[inside]
    np.maximum.at(above[0], c[r < 0], r[r < 0])
    np.minimum.at(below[rows], c[r >= rows], r[r >= rows])
    own = np.arange(rows)[:, None]
    return np.minimum(own - np.maximum.accumulate(above)[1:], np.minimum.accumulate(below[::-1])[::-1][:-1] - own)


def coast_distance(land: DataFrame, grid: Grid, cap: float = 20_000.0) -> DataFrame:
    """(row, col, distance) of land pixels: metres to the nearest sea pixel's centre, held at cap. land: (row, col, value), sea where value is null or 0; pixels that are missing are neither.

    An exact distance transform in two linear passes: down and up each column, the rows to the nearest sea; then along the rows the lower envelope
    of the columns' parabolas. Pixels are dealt to blocks by one exchange. Blocks are at least as high as the cap reaches, so of the bands above and below a block needs
    one sea pixel a column, the nearest; sea pixels near a block's side border go to the block beyond as well.
    """
    tall, wide = abs(grid.dy), abs(grid.dx)
    reach, halo = math.ceil(cap / tall), math.ceil(cap / wide)
    cols = max(4 * halo, 256)
    rows = max(reach, 1, BLOCK // (min(cols, grid.nx) + 2 * halo))
    marked = land.where("row IS NOT NULL AND col IS NOT NULL").select("row", "col", F.coalesce(F.col("value") == 0, F.lit(True)).alias("sea"), F.floor(F.col("row") / rows).alias("_band"))
    ends = marked.where("sea").groupBy("_band", "col").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    carried = lambda row, step: ends.select(row, "col", F.lit(True).alias("sea"), (F.col("_band") + step).alias("_band"))
    known = marked.unionAll(carried(F.col("last").alias("row"), 1)).unionAll(carried(F.col("first").alias("row"), -1))
    block = lambda c: F.floor(c / cols)
    far = F.when(F.col("sea"), halo).otherwise(0)
    dealt = known.withColumn("_block", F.explode(F.sequence(block(F.col("col") - far), block(F.col("col") + far))))

    def measure(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * rows, key[1].as_py() * cols - halo
        r, c, sea = (table.column(n).to_numpy() for n in ("row", "col", "sea"))
        r, c, dry = r - r0, c - c0, ~sea
        # columns from the first to the last that a source or a land pixel is in
        lo = c.min()
        gap = _gaps(r[sea], c[sea] - lo, rows, c.max() - lo + 1)[: r[dry].max(initial=-1) + 1] * tall
        found = np.sqrt(_envelope(np.where(gap <= cap, gap, np.inf) ** 2, wide)[r[dry], c[dry] - lo])
        return pa.table({"row": pa.array(r[dry] + r0, kind[0].type), "col": pa.array(c[dry] + c0, kind[1].type), "distance": np.minimum(found, cap)})

    schema = T.StructType([land.schema["row"], land.schema["col"], T.StructField("distance", T.DoubleType())])
    kind = to_arrow_schema(schema)
    return dealt.groupBy("_band", "_block").applyInArrow(measure, schema)
