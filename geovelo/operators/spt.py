"""Standard penetration tests: N60 and velocity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import require, rint
from ..functions.spt_correlations import HAMMERS, SOILS, bore_factor, energy_factor, rod_factor, spt_velocity


def checked(boreholes: DataFrame) -> DataFrame:
    """Hammer and soil names checked; null ones are Auto and Clay."""
    hammer, soil = F.coalesce("hammer", F.lit("Auto")), F.coalesce("soil", F.lit("Clay"))
    return boreholes.withColumns({"hammer": require(hammer.isin(*HAMMERS), hammer, "unknown hammer type"), "soil": require(soil.isin(*SOILS), soil, "unknown soil type")})


def info(boreholes: DataFrame) -> DataFrame:
    """(spt_id, z_min, z_max, z_spread): depths of the first and last row, as they are; no row is ever removed."""
    first, last = F.min_by("depth", "pos"), F.max_by("depth", "pos")
    return boreholes.groupBy("spt_id").agg(first.alias("z_min"), last.alias("z_max"), (last - first).alias("z_spread"))


def n60(boreholes: DataFrame) -> DataFrame:
    """Adds n60: N times the energy, bore and rod factors, the depth taken as rod length, rounded to two places."""
    raw = F.col("n") * energy_factor(F.col("energy_ratio"), F.col("hammer")) * bore_factor(F.col("diameter")) * rod_factor(F.col("depth"))
    return checked(boreholes).withColumn("n60", rint(raw, 2))


def profiles(boreholes: DataFrame, names: list[str]) -> DataFrame:
    """(spt_id, vs_correlation, pos, depth, vs, vs_sd, eff_stress): each borehole under each named correlation; rows without blows are left out and pos counts the others."""
    counted = n60(boreholes).where("n60 > 0").withColumn("pos", F.row_number().over(Window.partitionBy("spt_id").orderBy("pos")))
    each = []
    for name in names:
        vs, sd, stress = spt_velocity(name, F.col("n60"), F.col("depth"), F.col("soil"))
        each.append(F.struct(F.lit(name).alias("vs_correlation"), vs.alias("vs"), sd.alias("vs_sd"), stress.alias("eff_stress")))
    return counted.withColumn("_p", F.explode(F.array(*each))).select("spt_id", "_p.vs_correlation", "pos", "depth", "_p.vs", "_p.vs_sd", "_p.eff_stress")
