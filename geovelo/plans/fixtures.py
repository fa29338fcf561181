"""Deterministic domain tables made of the driver's tables, in Spark and, for the oracle, in SQL. The arithmetic is the same on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.raster import Grid
from ..shared import dealt

_ORDER = "l_orderkey l_linenumber l_partkey l_quantity l_extendedprice l_discount l_tax l_shipdate".split()
X0, Y0, SIDE = 1_500_000, 5_100_000, 200_000
#: Source and target rasters over the box.
GRID, FINE = Grid(X0, Y0 + SIDE, 2000.0, -2000.0, 100, 100), Grid(X0, Y0 + SIDE, 1250.0, -1250.0, 160, 160)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soundings(spark: SparkSession, sf_dir: str, qc: float = 0.0, fs: float = 0.0, uneven: bool = False) -> DataFrame:
    """A sounding a supplier; qc and fs are added to those columns. uneven: every third sounding has narrower steps, so that it ends above 30 m."""
    step = F.when(F.lit(uneven) & (F.col("l_suppkey") % 3 == 0), (20 + F.col("l_suppkey") % 7) / 1000.0).otherwise(0.05)
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_ORDER))
    rows = dealt(read(spark, sf_dir, "lineitem").select(*_ORDER, "l_suppkey"), "l_suppkey").select(F.col("l_suppkey").alias("cpt_id"), pos.alias("pos"), step.alias("step"), "l_quantity", "l_tax", "l_discount")
    return rows.select("cpt_id", "pos", (F.col("pos") * F.col("step")).alias("depth"), (0.4 * F.col("l_quantity") + qc).alias("qc"), (F.col("l_tax") + fs).alias("fs"), (0.1 * F.col("l_discount")).alias("u"), F.lit(1.0).alias("gwl"), F.lit(0.8).alias("nar"))


def soundings_sql(qc: float = 0.0, fs: float = 0.0, uneven: bool = False) -> str:
    step = "CASE WHEN cpt_id % 3 = 0 THEN (20 + cpt_id % 7) / 1000.0::DOUBLE ELSE 0.05::DOUBLE END" if uneven else "0.05::DOUBLE"
    return f"""snd AS (SELECT cpt_id, pos, pos * {step} AS depth, 0.4::DOUBLE * l_quantity + {qc}::DOUBLE AS qc, l_tax + {fs}::DOUBLE AS fs, 0.1::DOUBLE * l_discount AS u
      FROM (SELECT l_suppkey AS cpt_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(_ORDER)}) AS INTEGER) AS pos, l_quantity, l_tax, l_discount FROM lineitem))"""


def boreholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A borehole a part."""
    pos = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*["l_orderkey", "l_linenumber", "l_suppkey", *_ORDER[3:]]))
    flag = F.concat("l_returnflag", "l_linestatus")
    soil = F.when(flag == "AF", "Sand").when(flag == "RF", "Silt").when(flag == "NF", "Gravel").otherwise("Clay")
    lines = read(spark, sf_dir, "lineitem").select(*_ORDER, "l_suppkey", "l_returnflag", "l_linestatus")
    rows = dealt(lines, "l_partkey").select("l_partkey", pos.alias("pos"), F.col("l_quantity").alias("n"), soil.alias("soil"))
    size = F.col("p_size")
    head = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.when(size % 3 == 0, "Auto").when(size % 3 == 1, "Safety").otherwise("Standard").alias("hammer"),
        F.when(size % 4 == 0, 100.0).when(size % 4 == 1, 200.0).otherwise(150.0).alias("diameter"), F.when(size % 5 == 0, 72.0).alias("energy_ratio"),
    )
    return rows.join(head, "l_partkey").select(F.col("l_partkey").alias("spt_id"), "pos", F.col("pos").cast("double").alias("depth"), "n", "soil", "hammer", "diameter", "energy_ratio")


BOREHOLES_SQL = f"""bh AS (SELECT l_partkey AS spt_id, pos, CAST(pos AS DOUBLE) AS depth, n, soil,
      CASE p_size % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Safety' ELSE 'Standard' END AS hammer, CASE p_size % 4 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 200.0 ELSE 150.0 END AS diameter, CASE WHEN p_size % 5 = 0 THEN 72.0::DOUBLE END AS energy_ratio
      FROM (SELECT l_partkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, {", ".join(_ORDER[3:])}) AS INTEGER) AS pos, l_quantity AS n,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Sand' WHEN 'RF' THEN 'Silt' WHEN 'NF' THEN 'Gravel' ELSE 'Clay' END AS soil FROM lineitem) l JOIN part ON p_partkey = l_partkey)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured site a supplier, in a box of 200 km."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("site_id"), (X0 + k * 7919 % SIDE).cast("double").alias("easting"), (Y0 + k * 104729 % SIDE).cast("double").alias("northing"), (150 + k * 37 % 700).cast("double").alias("vs30"),
        F.when(k % 3 == 0, 0.1).when(k % 3 == 1, 0.2).otherwise(0.5).alias("uncertainty"), (1 + k % 15).cast("int").alias("gid"), (1 + k % 16).cast("int").alias("tid"),
    )


SITES_SQL = f"""site AS (SELECT s_suppkey AS site_id, CAST({X0} + s_suppkey * 7919 % {SIDE} AS DOUBLE) AS easting, CAST({Y0} + s_suppkey * 104729 % {SIDE} AS DOUBLE) AS northing, CAST(150 + s_suppkey * 37 % 700 AS DOUBLE) AS vs30,
      CASE s_suppkey % 3 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.2 ELSE 0.5 END AS uncertainty, CAST(1 + s_suppkey % 15 AS INTEGER) AS gid, CAST(1 + s_suppkey % 16 AS INTEGER) AS tid FROM supplier)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query location an order, in the same box."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("point_id"), (X0 + k * 15485863 % SIDE).cast("double").alias("easting"), (Y0 + k * 32452843 % SIDE).cast("double").alias("northing"), (k % 17).cast("int").alias("gid"), (k % 18).cast("int").alias("tid"),
        ((k * 31 % 977) / 2000.0).alias("slope"), (k * 101 % 30011).cast("double").alias("coast"),
    )


POINTS_SQL = f"""pt AS (SELECT o_orderkey AS point_id, CAST({X0} + o_orderkey * 15485863 % {SIDE} AS DOUBLE) AS easting, CAST({Y0} + o_orderkey * 32452843 % {SIDE} AS DOUBLE) AS northing, CAST(o_orderkey % 17 AS INTEGER) AS gid, CAST(o_orderkey % 18 AS INTEGER) AS tid,
      (o_orderkey * 31 % 977) / 2000.0::DOUBLE AS slope, CAST(o_orderkey * 101 % 30011 AS DOUBLE) AS coast FROM orders)"""

_CORNERS = ((1000, 500), (38000, 1500), (39500, 38000), (2000, 39000))


def _corners(grown: int) -> tuple:
    return tuple((x + (grown if x > 20_000 else -grown), y + (grown if y > 20_000 else -grown)) for x, y in _CORNERS)


def polygons(spark: SparkSession, sf_dir: str, grown: int = 0) -> DataFrame:
    """A four-sided polygon a nation, 5 by 5 over the box, with gaps between them, or overlapping if grown by some km."""
    corners = _corners(grown)
    k = F.col("n_nationkey")
    x, y = X0 + (k % 5) * 40_000, Y0 + F.floor(k / 5) * 40_000
    sides = [F.struct(*[(c + F.lit(d)).cast("double").alias(n) for n, c, d in (("x1", x, a[0]), ("y1", y, a[1]), ("x2", x, b[0]), ("y2", y, b[1]))]) for a, b in zip(corners, (*corners[1:], corners[0]), strict=True)]
    return read(spark, sf_dir, "nation").withColumn("e", F.explode(F.array(*sides))).select((k + 1).cast("int").alias("gid"), k.cast("int").alias("feature_ord"), "e.*")


def polygons_sql(grown: int = 0) -> str:
    corners = _corners(grown)
    return "edge AS (" + " UNION ALL ".join(
        f"SELECT CAST(n_nationkey + 1 AS INTEGER) AS gid, CAST(n_nationkey AS INTEGER) AS feature_ord, CAST({X0} + n_nationkey % 5 * 40000 + {a[0]} AS DOUBLE) AS x1, CAST({Y0} + n_nationkey // 5 * 40000 + {a[1]} AS DOUBLE) AS y1, CAST({X0} + n_nationkey % 5 * 40000 + {b[0]} AS DOUBLE) AS x2, CAST({Y0} + n_nationkey // 5 * 40000 + {b[1]} AS DOUBLE) AS y2 FROM nation"
        for a, b in zip(corners, (*corners[1:], corners[0]), strict=True)
    ) + ")"


POLYGONS_SQL = polygons_sql()


_PIXEL = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % {n}"


def _pixels(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """(row, col, t): the pixels that some line of an order falls on, with the sum of its parts. Few lines leave pixels out."""
    i = F.expr(_PIXEL.format(n=grid.nx * grid.ny))
    held = read(spark, sf_dir, "lineitem").groupBy(i.alias("i")).agg(F.sum("l_partkey").alias("t"))
    return held.select(F.floor(F.col("i") / grid.nx).cast("int").alias("row"), (F.col("i") % grid.nx).cast("int").alias("col"), "t")


_PIXELS_SQL = f"(SELECT i // {GRID.nx} AS r, i % {GRID.nx} AS c, t FROM (SELECT {_PIXEL.format(n=GRID.nx * GRID.ny)} AS i, sum(l_partkey) AS t FROM lineitem GROUP BY 1))"


def raster(spark: SparkSession, sf_dir: str, grid: Grid = GRID) -> DataFrame:
    """A raster of categories 0 to 16 over the grid."""
    return _pixels(spark, sf_dir, grid).select("row", "col", (F.col("t") % 17).cast("double").alias("value"))


RASTER_SQL = f"ras AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(t % 17 AS DOUBLE) AS value FROM {_PIXELS_SQL})"


def land(spark: SparkSession, sf_dir: str, grid: Grid = GRID) -> DataFrame:
    """1 on land, 0 on sea: a slanted coast in the west, a bay and a few ponds."""
    r, c = F.col("row"), F.col("col")
    sea = (c * 3 + r < 90) | ((r - 60) * (r - 60) + (c - 80) * (c - 80) < 30) | (F.col("t") % 997 == 0)
    return _pixels(spark, sf_dir, grid).select("row", "col", F.when(sea, 0.0).otherwise(1.0).alias("value"))


LAND_SQL = f"""land AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE WHEN c * 3 + r < 90 OR (r - 60) * (r - 60) + (c - 80) * (c - 80) < 30 OR t % 997 = 0 THEN 0 ELSE 1 END AS value, {GRID.x0}::DOUBLE + (c + 0.5::DOUBLE) * {GRID.dx}::DOUBLE AS x, {GRID.y0}::DOUBLE + (r + 0.5::DOUBLE) * ({GRID.dy}::DOUBLE) AS y
      FROM {_PIXELS_SQL})"""
