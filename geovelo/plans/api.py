"""The calls behind a web form, without the web: each takes and returns DataFrames. Errors are Python or Spark exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cpt_correlations import CPT_CORRELATIONS
from ..functions.spt_correlations import HAMMERS, SOILS, SPT_CORRELATIONS
from ..functions.vs30_correlations import VS30_CORRELATIONS
from ..operators import cpt, ensemble, profile, spt
from . import pipeline


def cpt_correlations() -> list[str]:
    return list(CPT_CORRELATIONS)


def spt_correlations() -> list[str]:
    return list(SPT_CORRELATIONS)


def vs30_correlations() -> list[str]:
    return list(VS30_CORRELATIONS)


def hammer_types() -> list[str]:
    return list(HAMMERS)


def soil_types() -> list[str]:
    return list(SOILS)


def create_cpt(soundings: DataFrame) -> DataFrame:
    """Filtered soundings in MPa."""
    return cpt.guess_units(cpt.valid(soundings))


def create_spt(boreholes: DataFrame) -> DataFrame:
    return spt.n60(boreholes)


def create_profile(rows: DataFrame) -> DataFrame:
    """Uploaded profiles (name, pos, depth, vs, vs_sd, layered), truncated."""
    return profile.truncate(rows, ("name",))


def cpt_midpoints(soundings: DataFrame) -> DataFrame:
    """(cpt_id, measure, point, depth, value) of qc, fs and u as staggered lines."""
    out = None
    for name in ("qc", "fs", "u"):
        one = profile.midpoints(soundings, ("cpt_id",), name).select("cpt_id", F.lit(name).alias("measure"), "point", "depth", F.col(name).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def spt_midpoints(boreholes: DataFrame) -> DataFrame:
    """(spt_id, measure, point, depth, value) of N and N60."""
    both = spt.n60(boreholes)
    one = lambda c: profile.midpoints(both, ("spt_id",), c).select("spt_id", F.lit(c).alias("measure"), "point", "depth", F.col(c).alias("value"))
    return one("n").unionByName(one("n60"))


def profile_midpoints(truncated: DataFrame, name: str, layered: bool | str = False) -> DataFrame:
    """(label, point, depth, vs, vs_below, vs_above) of truncated profiles as staggered lines with their sigma band."""
    keys = (name, "vs_correlation")  # not the label: rows dealt by the name are not shuffled again
    vs_and_sd = truncated.withColumn("vs_sd", F.coalesce("vs_sd", F.lit(0.0)))
    line = profile.layers(vs_and_sd, keys, "vs", layered).withColumn("label", ensemble.label(F.col(name).cast("string"), F.col("vs_correlation")))
    order = Window.partitionBy(*keys).orderBy("pos")
    numbered = line.withColumn("_k", F.row_number().over(order) - 1)
    ends = F.array(F.struct((2 * F.col("_k")).alias("point"), F.col("z_top").alias("depth")), F.struct((2 * F.col("_k") + 1).alias("point"), F.col("z_bot").alias("depth")))
    return profile.sigma_band(numbered.withColumn("_e", F.explode(ends)).select("label", "_e.point", "_e.depth", "vs", "vs_sd")).drop("vs_sd")


def average(profiles: DataFrame, weights: DataFrame, keys: tuple[str, ...], layered: bool | str = False) -> DataFrame:
    """(point, depth, vs, vs_below, vs_above): the weighted mean curve of truncated profiles (name, vs_correlation, vs30_correlation, ..)."""
    return profile.sigma_band(ensemble.average_profile(ensemble.weighted(profiles, weights), keys, layered=layered)).drop("vs_sd")


def vs30(profiles: DataFrame, weights: DataFrame, keys: tuple[str, ...], correlations: list[str]) -> DataFrame:
    """(vs30, vs30_sd) of the weighted ensemble of truncated profiles."""
    return ensemble.weighted_vs30(ensemble.weighted(pipeline.profile_vs30(profiles, keys, correlations), weights))
