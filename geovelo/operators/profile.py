"""Velocity profiles: truncation, layers, time averages and Vs30. A profile is the rows of one key in the order of pos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vs30_correlations as v30
from ..functions.numeric import require, strict_sum

DEEPEST = 30


def _marked(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """profiles plus z, _kept (not below z), _moved (the row that moves up to z) and the row above's _depth, _vs and _vs_sd."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("pos")
    z = F.least(F.floor(F.max("depth").over(whole)), F.lit(DEEPEST)).cast("int")
    marked = profiles.withColumn("z", z).withColumn("_kept", F.col("depth") <= F.col("z"))
    marked = marked.withColumns({f"_{c}": F.lag(c).over(order) for c in ("depth", "vs", "vs_sd", "_kept")})
    moved = ~F.col("_kept") & F.coalesce(F.col("__kept"), F.lit(False)) & (F.col("_depth") != F.col("z"))
    return marked.withColumn("_moved", moved).drop("__kept")


def info(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, z_min, z_max, z_spread, removed): depths over all rows, the one that truncate moves up at its new place; removed holds the 0-based positions of rows that truncate drops."""
    depth = F.when(F.col("_moved"), F.col("z").cast("double")).otherwise(F.col("depth"))
    gone = F.array_sort(F.collect_list(F.when(~(F.col("_kept") | F.col("_moved")), F.col("pos") - 1)))
    return _marked(profiles, keys).groupBy(*keys).agg(F.min(depth).alias("z_min"), F.max(depth).alias("z_max"), (F.max(depth) - F.min(depth)).alias("z_spread"), gone.alias("removed"))


def truncate(profiles: DataFrame, keys: Sequence[str], average_shallow: bool = False) -> DataFrame:
    """Rows down to z = least(whole metres of the greatest depth, 30), with z as a column.

    If the last row kept is not at z, the next row is moved up to z. It keeps its own velocity if z is past the middle of
    the two rows, else it takes the last kept row's velocity and sd. average_shallow replaces velocities down to 3 m by the mean from 2.5 to 3.5 m.
    """
    whole = Window.partitionBy(*keys)
    own = (F.col("depth") + F.col("_depth")) / 2 < F.col("z")
    pick = lambda c: F.when(F.col("_moved") & ~own, F.col(f"_{c}")).otherwise(F.col(c))
    cut = _marked(profiles, keys).where(F.col("_kept") | F.col("_moved"))
    cut = cut.withColumns({"vs": pick("vs"), "vs_sd": pick("vs_sd"), "depth": F.when(F.col("_moved"), F.col("z").cast("double")).otherwise(F.col("depth"))}).drop("_kept", "_moved", "_depth", "_vs", "_vs_sd")
    if average_shallow:
        mean = F.avg(F.when(F.col("depth").between(2.5, 3.5), F.col("vs"))).over(whole)
        cut = cut.withColumn("vs", F.when(F.col("depth") <= 3, mean).otherwise(F.col("vs")))
    return cut


def layers(rows: DataFrame, keys: Sequence[str], value: str = "vs", layered: bool | str = False) -> DataFrame:
    """rows plus z_top and z_bot: the stretch of depth over which a row's value holds.

    Borders are half-way between rows, or, for layered profiles, at the rows; the first layer starts at 0 and the last one
    ends at its row. A first row of value 0 is dropped and the second one starts at 0. layered may name a boolean column.
    """
    order, whole = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*keys)
    first = F.row_number().over(order) == 1
    kept = rows.withColumn("_skip", first & (F.col(value) == 0) & (F.count(F.lit(1)).over(whole) > 1)).where("NOT coalesce(_skip, false)").drop("_skip")
    flag = F.coalesce(F.col(layered), F.lit(False)) if isinstance(layered, str) else F.lit(layered)
    above, below = F.lag("depth").over(order), F.lead("depth").over(order)
    top = F.when(flag, above).otherwise((F.col("depth") + above) / 2)
    bottom = F.when(flag, F.col("depth")).otherwise((F.col("depth") + below) / 2)
    return kept.withColumns({"z_top": F.coalesce(top, F.lit(0.0)), "z_bot": F.coalesce(bottom, F.col("depth"))})


def midpoints(rows: DataFrame, keys: Sequence[str], value: str = "vs", layered: bool | str = False) -> DataFrame:
    """(keys, point, depth, value): the layers as a staggered line, two points a layer, numbered from 0."""
    order = Window.partitionBy(*keys).orderBy("pos")
    numbered = layers(rows, keys, value, layered).withColumn("_k", F.row_number().over(order) - 1)
    ends = F.array(F.struct((2 * F.col("_k")).alias("point"), F.col("z_top").alias("depth")), F.struct((2 * F.col("_k") + 1).alias("point"), F.col("z_bot").alias("depth")))
    return numbered.withColumn("_e", F.explode(ends)).select(*keys, "_e.point", "_e.depth", value)


def sigma_band(rows: DataFrame) -> DataFrame:
    """Adds vs_below and vs_above, one standard deviation of ln vs away."""
    return rows.withColumns({"vs_below": F.col("vs") * F.exp(-F.col("vs_sd")), "vs_above": F.col("vs") * F.exp("vs_sd")})


def vsz(truncated: DataFrame, keys: Sequence[str], layered: bool | str = False) -> DataFrame:
    """(keys, z, vsz): depth over travel time. Null if a layer has no velocity or velocity 0."""
    time = F.try_divide(F.col("z_bot") - F.col("z_top"), F.col("vs"))
    return layers(truncated, keys, "vs", layered).groupBy(*keys).agg(F.max("z").alias("z"), strict_sum(time).alias("_t")).withColumn("vsz", F.try_divide(F.col("z"), F.col("_t"))).drop("_t")


def vs30(averages: DataFrame, shallow_is_null: bool = False) -> DataFrame:
    """averages (.., z, vsz, vs30_correlation) plus vs30 and vs30_sd. At z = 30 these are vsz and 0, else the named correlation's; an unknown name or too shallow a profile is an error. shallow_is_null: a profile too shallow for its correlation has null instead, and the others go on."""
    c = F.broadcast(v30.coefficients(averages.sparkSession))
    known = F.coalesce(F.col("vs30_correlation"), F.lit("")).isin(*v30.VS30_CORRELATIONS)
    joined = averages.withColumn("vs30_correlation", require(known | (F.col("z") == DEEPEST), F.col("vs30_correlation"), "unknown vs30 correlation")).join(c, ["vs30_correlation", "z"], "left")
    deep = F.col("z") == DEEPEST
    value = F.when(deep, F.col("vsz")).otherwise(v30.vs30(F.col("vsz"), F.col("a"), F.col("b"), F.col("c")))
    if not shallow_is_null:
        value = require(deep | F.col("sigma").isNotNull(), value, "profile is not deep enough")
    sd = F.when(deep, 0.0).otherwise(v30.vs30_sd(F.col("vsz"), F.col("b"), F.col("c"), F.col("sigma")))
    return joined.withColumns({"vs30": value, "vs30_sd": sd}).select(*averages.columns, "vs30", "vs30_sd")
