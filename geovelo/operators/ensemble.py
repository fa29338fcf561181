"""Weighted ensembles of velocity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import require, strict_sum
from .profile import layers

#: Resolution of the averaged curve in m, and the share by which given weights may miss 1.
STEP, SLACK = 0.005, 0.02
#: Velocities are summed as offsets from this one, in m/s, so that little cancels in their variance.
SHIFT = 300.0
#: Weights up to which they go to every task (some 50 bytes each), so that profiles stay where their key put them.
BROADCAST_WEIGHTS = 500_000


def normalised(weights: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """weights (kind, key, weight) with each kind's weights summing to 1; an error if they miss 1 by more than SLACK."""
    total = F.sum("weight").over(Window.partitionBy(*by))
    return weights.withColumn("weight", require(total.between(1 - SLACK, 1 + SLACK), F.col("weight") / total, "weights sum is not close enough to 1"))


def equal_weights(keys: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Each key of a kind weighs 1/n."""
    return keys.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by)))


def section_weights(sections: DataFrame, keys: DataFrame) -> DataFrame:
    """(kind, key, weight): a section's weight times the weight of the sounding in it. Joined by equality of kind."""
    return keys.join(sections.select("kind", F.col("weight").alias("_s")), "kind").withColumn("weight", F.col("weight") * F.col("_s")).drop("_s")


def weighted(profiles: DataFrame, weights: DataFrame) -> DataFrame:
    """profiles plus weight, the product of the normalised weights of kinds 'profile', 'vs' and 'vs30' under name, vs_correlation and vs30_correlation.

    A null correlation weighs 1; a key without a weight is an error. The weights are one row a name. They are counted: up to BROADCAST_WEIGHTS go to every task, beyond that
    profiles and weights meet by name.
    """
    out, product = profiles, F.lit(1.0)
    known = normalised(weights)
    few = weights.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS
    for kind, column in (("profile", "name"), ("vs", "vs_correlation"), ("vs30", "vs30_correlation")):
        own = known.where(F.col("kind") == kind).select(F.col("key").alias(column), F.col("weight").alias(f"_{kind}"))
        out = out.join(F.broadcast(own) if few else own, column, "left")
        found = F.when(F.col(column).isNull(), 1.0).otherwise(F.col(f"_{kind}"))
        product = product * require(found.isNotNull(), found, f"a {kind} key has no weight")
    return out.withColumn("weight", product).drop("_profile", "_vs", "_vs30")


def weighted_vs30(profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, vs30, vs30_sd) of profiles (by, vs30, vs30_sd, weight): the weighted mean, and ln of the root of the variance within and between profiles (0 without variance). Weights are taken as they are. Null if any profile has no value."""
    w, off = F.col("weight"), F.col("vs30") - SHIFT
    sums = {"vs30": w * F.col("vs30"), "_w": w, "_o": w * off, "_oo": w * off * off, "_within": w * F.col("vs30_sd") * F.col("vs30_sd")}
    told = profiles.groupBy(*by).agg(*[strict_sum(x).alias(c) for c, x in sums.items()], F.min("vs30").alias("_least"), F.max("vs30").alias("_most"))
    mean = F.col("vs30") - SHIFT
    spread = F.greatest(F.lit(0.0), F.col("_oo") - 2 * mean * F.col("_o") + mean * mean * F.col("_w"))
    alike = F.col("_w") * (F.col("_least") - F.col("vs30")) * (F.col("_least") - F.col("vs30"))  # nothing is left over where all profiles are equal
    variance = F.col("_within") + F.when(F.col("_least") == F.col("_most"), alike).otherwise(spread)
    out = told.withColumn("_v", variance)
    return out.select(*by, "vs30", F.when(F.col("_v") == 0, 0.0).otherwise(F.log(F.sqrt("_v"))).alias("vs30_sd"))


def average_profile(truncated: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = (), layered: bool | str = False) -> DataFrame:
    """(by, point, depth, vs, vs_sd): the weighted mean curve of truncated profiles (keys, pos, depth, vs, vs_sd, weight).

    Sampled at multiples of STEP; a profile counts between its first and last row, where its velocity is not 0; weights are made to sum to 1 at each step.
    Over a gap two points stand half-way, with the values on either side; a curve that starts below 0 is drawn up to 0.
    """
    every = tuple(dict.fromkeys((*by, *keys)))
    order, whole = Window.partitionBy(*every).orderBy("pos"), Window.partitionBy(*every)
    ends = truncated.withColumns({"_from": F.min("depth").over(whole), "_to": F.max("depth").over(whole)})
    cut = layers(ends, every, "vs", layered).withColumn("_last", F.lead("pos").over(order).isNull())
    first = F.ceil(F.greatest("z_top", "_from") / STEP)
    last = F.when(F.col("_last"), F.floor(F.col("z_bot") / STEP)).otherwise(F.ceil(F.col("z_bot") / STEP) - 1)
    # two rows a layer, where it starts and after it ends; running sums between them are the same at all steps up to the next such row
    sums = {"n": F.lit(1), "n_w": F.col("weight").isNotNull().cast("int"), "n_sd": (F.col("weight") * F.col("vs_sd")).isNotNull().cast("int"), "w": F.col("weight"), "wv": F.col("weight") * F.col("vs"), "ws": F.col("weight") * F.col("vs_sd") * F.col("vs_sd")}
    ends = F.array(F.struct(first.alias("step"), F.lit(1).alias("sign")), F.struct((last + 1).alias("step"), F.lit(-1).alias("sign")))
    turned = cut.where("vs != 0").where(first <= last).select(*by, *[x.alias(f"_{c}") for c, x in sums.items()], F.explode(ends).alias("_e"))
    turned = turned.groupBy(*by, F.col("_e.step").alias("step")).agg(*[F.sum(F.col(f"_{c}") * F.col("_e.sign")).alias(f"_{c}") for c in sums])
    up = Window.partitionBy(*by).orderBy("step")
    held = turned.select(*by, "step", F.lead("step").over(up).alias("_next"), *[F.sum(f"_{c}").over(up).alias(f"_{c}") for c in sums]).where("_n > 0")
    mean = F.when(F.col("_n_w") > 0, F.col("_wv") / F.col("_w"))
    sd = F.when(F.col("_n_sd") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("_ws") / F.col("_w"))))
    curve = held.select(*by, F.explode(F.sequence("step", F.col("_next") - 1)).alias("step"), mean.alias("vs"), sd.alias("vs_sd"))
    along = Window.partitionBy(*by).orderBy("step")
    before = {f"_{c}": F.lag(c).over(along) for c in ("step", "vs", "vs_sd")}
    point = lambda d, v, s: F.struct(d.alias("depth"), v.alias("vs"), s.alias("vs_sd"))
    depth = F.col("step") * STEP
    own = point(depth, F.col("vs"), F.col("vs_sd"))
    middle = (F.col("_step") * STEP + depth) / 2
    bridge = F.array(point(middle, F.col("_vs"), F.col("_vs_sd")), point(middle, F.col("vs"), F.col("vs_sd")), own)
    start = F.array(point(F.lit(0.0), F.col("vs"), F.col("vs_sd")), own)
    drawn = F.when(F.col("_step").isNull() & (F.col("step") > 0), start).when(F.col("step") - F.col("_step") > 1, bridge).otherwise(F.array(own))
    points = curve.withColumns(before).select(*by, "step", F.posexplode(drawn).alias("_k", "_p"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("step", "_k")) - 1
    return points.select(*by, number.alias("point"), "_p.depth", "_p.vs", "_p.vs_sd")


def label(name: Column, correlation: Column) -> Column:
    """name_correlation, or the name alone without a correlation."""
    return F.concat_ws("_", name, correlation)
