"""Cone soundings: filters, unit guesses, stresses and soil parameters, as one lazy plan over all soundings.

A sounding is the rows of one cpt_id in the order of pos. All windows share the partitioning on cpt_id, so a chain of these
operators shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cpt_correlations import ATMOSPHERE, CPT_CORRELATIONS
from ..functions.numeric import finite, require, rint

#: Steps of the fixed point; a row that has not settled by then is an error.
MAX_STEPS, SETTLED = 64, 0.01
#: Steps in generated code.
UNROLLED = 4


def _order():
    return Window.partitionBy("cpt_id").orderBy("pos")


def _valid() -> Column:
    return (F.col("qc") > 0) & (F.col("fs") > 0)


def info(soundings: DataFrame) -> DataFrame:
    """(cpt_id, z_min, z_max, z_spread, removed): depths of the first and last row before the filter; removed holds the 0-based positions of rows without positive qc and fs. An error if no row is left."""
    first, last = F.min_by("depth", "pos"), F.max_by("depth", "pos")
    gone = F.array_sort(F.collect_list(F.when(~F.coalesce(_valid(), F.lit(False)), F.col("pos") - 1)))
    kept = F.count(F.when(_valid(), 1))
    return soundings.groupBy("cpt_id").agg(rint(first, 2).alias("z_min"), rint(last, 2).alias("z_max"), rint(last - first, 2).alias("z_spread"), require(kept > 0, gone, "sounding has no valid rows").alias("removed"))


def valid(soundings: DataFrame) -> DataFrame:
    """Rows with positive qc and fs, pos renumbered from 1."""
    return soundings.where(_valid()).withColumn("pos", F.row_number().over(_order()))


def kpa_to_mpa(soundings: DataFrame) -> DataFrame:
    return soundings.withColumns({c: F.col(c) / 1000 for c in ("qc", "fs", "u")})


def guess_units(soundings: DataFrame) -> DataFrame:
    """Pore pressure and sleeve friction brought to MPa by the size of one valid row of the sounding: u by row 51, divided by 1000 until it is below 10; fs by row 101, else row 6, divided once if above 1."""
    at = lambda c, k: F.max(F.when(F.col("pos") == k, F.col(c))).over(Window.partitionBy("cpt_id"))
    marked = soundings.withColumns({"_u": at("u", 51), "_fs": F.when(F.count(F.lit(1)).over(Window.partitionBy("cpt_id")) > 100, at("fs", 101)).otherwise(at("fs", 6))})
    u, mark, scaled = F.col("u"), F.col("_u"), F.when(F.lit(False), F.lit(0.0))
    for _ in range(5):
        scaled = scaled.when(F.coalesce(mark < 10, F.lit(True)), u)
        u, mark = u / 1000, mark / 1000
    return marked.withColumns({"u": scaled.otherwise(u), "fs": F.when(F.col("_fs") > 1, F.col("fs") / 1000).otherwise(F.col("fs"))}).drop("_u", "_fs")


def corrected_tip(soundings: DataFrame) -> DataFrame:
    """Adds qt."""
    return soundings.withColumn("qt", F.col("qc") + F.col("u") * (1 - F.col("nar")))


def unit_weight(qc: Column, fs: Column, qt: Column) -> Column:
    """MN/m3, from the friction ratio; a fixed weight where qc or fs is not positive; not below 0.014."""
    ratio = 100 * fs / F.nullif(qt, F.lit(0.0))
    weight = 9.80665 / 1000 * (0.27 * F.log10(ratio) + 0.36 * F.log10(qt / ATMOSPHERE) + 1.236)
    weight = F.when((qc <= 0) | (fs <= 0), 0.00981 * 1.9).otherwise(weight)
    return F.when(weight.isNotNull(), F.greatest(weight, F.lit(0.014)))


def stresses(soundings: DataFrame) -> DataFrame:
    """Adds gamma, total_stress, u0 and eff_stress (MPa). From the first row without a unit weight on, stresses are null. The first row never has pore pressure."""
    with_weight = corrected_tip(soundings).withColumn("gamma", unit_weight(F.col("qc"), F.col("fs"), F.col("qt")))
    step = F.col("gamma") * (F.col("depth") - F.coalesce(F.lag("depth").over(_order()), F.lit(0.0)))
    run = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.when(F.count("_step").over(run) == F.count(F.lit(1)).over(run), F.sum("_step").over(run))
    u0 = F.when((F.row_number().over(_order()) > 1) & (F.col("depth") >= F.col("gwl")), 0.00981 * (F.col("depth") - F.col("gwl"))).otherwise(0.0)
    summed = with_weight.withColumn("_step", step).withColumns({"total_stress": total, "u0": u0})
    return summed.withColumn("eff_stress", F.col("total_stress") - F.col("u0")).drop("_step")


def _exponent(n: Column) -> tuple[Column, Column, Column]:
    """(n, qtn, ic) that follow from a stress exponent."""
    factor = F.least(F.lit(1.7), finite(F.pow(ATMOSPHERE / F.nullif(F.col("eff_stress"), F.lit(0.0)), n)))
    qtn = F.col("_net") / ATMOSPHERE * F.when(F.col("eff_stress") > 0, factor)
    ic = F.sqrt(F.pow(3.47 - F.log10(qtn), F.lit(2.0)) + F.pow(F.col("_lfr"), F.lit(2.0)))
    raw = 0.381 * ic + F.col("_shift")
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), raw)), qtn, ic


def soil_parameters(soundings: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Adds stresses, fr, qtn, ic and n: the fixed point of the stress exponent, row by row.

    Where the tip resistance is below the total stress there is no logarithm, so qtn keeps its first value and ic and n are
    null. A row that does not settle in max_steps is an error. Nearly all rows settle within a few steps, which are plain columns in generated code; only
    a row that hasn't goes on to the long form.
    """
    base = stresses(soundings).withColumn("_net", F.col("qt") - F.col("total_stress"))
    base = base.withColumn("fr", 100 * F.col("fs") / F.nullif(F.col("_net"), F.lit(0.0)))
    base = base.withColumns({"_lfr": F.log10("fr") + 1.22, "_shift": 0.05 * (F.col("eff_stress") / ATMOSPHERE) - 0.15})
    some = lambda x: F.when(F.col("depth").isNotNull(), F.lit(x))  # noqa: E731  a seed that may become null
    short = min(UNROLLED, max_steps)
    solved = base.withColumns({"n": some(0.5), "qtn": some(0.0), "ic": some(0.0), "_done": some(False)})
    for _ in range(short):
        solved = solved.withColumns(dict(zip(("_n", "_qtn", "_ic"), _exponent(F.col("n")))))
        keep = lambda c: F.when(F.col("_done"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        done = F.col("_done") | F.coalesce(F.abs(F.col("n") - F.col("_n")) < SETTLED, F.lit(True))
        solved = solved.select(*[c for c in base.columns], keep("n"), keep("qtn"), keep("ic"), done.alias("_done"))

    def step(state: Column, _: Column) -> Column:
        n, qtn, ic = _exponent(state["n"])
        settled = F.coalesce(F.abs(state["n"] - n) < SETTLED, F.lit(True))
        return F.when(state["done"], state).otherwise(F.struct(n.alias("n"), qtn.alias("qtn"), ic.alias("ic"), settled.alias("done")))

    state = F.struct("n", "qtn", "ic", F.col("_done").alias("done"))
    if max_steps > short:
        state = F.when(F.coalesce("_done", F.lit(True)), state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max_steps - short)), state, step))
    settled = lambda x: require(F.coalesce(F.col("_s.done"), F.lit(True)), F.col(f"_s.{x}"), "soil parameters did not settle")
    return solved.withColumn("_s", state).withColumns({x: settled(x) for x in ("qtn", "ic", "n")}).drop("_s", "_done", "_net", "_lfr", "_shift")


def profiles(soundings: DataFrame, names: list[str]) -> DataFrame:
    """(cpt_id, vs_correlation, pos, depth, vs, vs_sd, eff_stress): each sounding under each named correlation. The soil parameters are solved only if one of them needs it."""
    unknown = [x for x in names if x not in CPT_CORRELATIONS]
    if unknown:
        raise KeyError(f"{unknown} not among {sorted(CPT_CORRELATIONS)}")
    base = soil_parameters(soundings) if any(CPT_CORRELATIONS[x][1] for x in names) else stresses(soundings)
    each = []
    for name in names:
        vs, sd = CPT_CORRELATIONS[name][0]()
        each.append(F.struct(F.lit(name).alias("vs_correlation"), finite(vs).alias("vs"), finite(sd.cast("double")).alias("vs_sd")))
    return base.withColumn("_p", F.explode(F.array(*each))).select("cpt_id", "_p.vs_correlation", "pos", "depth", "_p.vs", "_p.vs_sd", "eff_stress")
