"""Errors as rows: inputs that can't be used go to a table by key with a named condition, and the others go on.

The operators themselves end a job at such an input. Each check gives (good, errors): good are the rows that no condition holds for, errors has
the key columns and condition, message and code, one row for each condition of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vs30_correlations as v30
from ..functions.spt_correlations import HAMMERS, SOILS
from .profile import DEEPEST

#: What is told of each condition, and its code: 400 for an input that is wrong, 500 for one that can't be computed.
CONDITIONS = {
    "NEGATIVE_DEPTH": ("depths must not be negative", 400),
    "NO_VALID_ROWS": ("sounding has no valid rows", 500),
    "UNKNOWN_HAMMER": ("unknown hammer type", 400),
    "UNKNOWN_SOIL": ("unknown soil type", 400),
    "UNKNOWN_CORRELATION": ("unknown vs30 correlation", 400),
    "TOO_SHALLOW": ("profile is not deep enough", 500),
}


def _errors(keyed: DataFrame, keys: Sequence[str], found: Mapping[str, Column]) -> DataFrame:
    each = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("condition"), F.lit(CONDITIONS[c][0]).alias("message"), F.lit(CONDITIONS[c][1]).alias("code"))) for c, bad in found.items()]
    return keyed.select(*keys, F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("_e")).select(*keys, "_e.*")


def _by_key(rows: DataFrame, key: str, some: Mapping[str, Column], every: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """some: conditions that one row of a key is enough for; every: those that all its rows must meet."""
    held = {c: F.coalesce(F.max(x), F.lit(False)) for c, x in some.items()} | {c: F.coalesce(F.min(x), F.lit(False)) for c, x in every.items()}
    told = rows.groupBy(key).agg(*[x.alias(c) for c, x in held.items()])
    # by a window on the key, whose partitioning all operators that follow share
    whole = Window.partitionBy(key)
    flags = [F.coalesce(F.max(x).over(whole), F.lit(False)) for x in some.values()] + [F.coalesce(F.min(x).over(whole), F.lit(False)) for x in every.values()]
    bad = flags[0]
    for more in flags[1:]:
        bad = bad | more
    return rows.withColumn("_bad", bad).where("NOT _bad").drop("_bad"), _errors(told, [key], {c: F.col(c) for c in held})


def cpt(soundings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soundings by cpt_id: none with a negative depth, or without a row of positive qc and fs."""
    unusable = ~F.coalesce((F.col("qc") > 0) & (F.col("fs") > 0), F.lit(False))
    return _by_key(soundings, "cpt_id", {"NEGATIVE_DEPTH": F.col("depth") < 0}, {"NO_VALID_ROWS": unusable})


def spt(boreholes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boreholes by spt_id: none with a negative depth, an unknown hammer or an unknown soil. No hammer and no soil are known ones."""
    odd = lambda c, known: F.col(c).isNotNull() & ~F.col(c).isin(*[x for x in known if x])
    return _by_key(boreholes, "spt_id", {"NEGATIVE_DEPTH": F.col("depth") < 0, "UNKNOWN_HAMMER": odd("hammer", HAMMERS), "UNKNOWN_SOIL": odd("soil", SOILS)}, {})


def vs30(averages: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, vs30_correlation, z, vsz) that profile.vs30() can extrapolate; the others' errors by keys and vs30_correlation."""
    coefficients = F.broadcast(v30.coefficients(averages.sparkSession).select(F.col("vs30_correlation").alias("_v"), F.col("z").alias("_z"), F.lit(True).alias("_held")))
    met = averages.join(coefficients, (F.col("vs30_correlation") == F.col("_v")) & (F.col("z") == F.col("_z")), "left").drop("_v", "_z")
    deep, known = F.coalesce(F.col("z") == DEEPEST, F.lit(False)), F.coalesce(F.col("vs30_correlation"), F.lit("")).isin(*v30.VS30_CORRELATIONS)
    unknown, shallow = ~known & ~deep, known & ~deep & F.col("_held").isNull()
    return met.where(~(unknown | shallow)).drop("_held"), _errors(met, [*keys, "vs30_correlation"], {"UNKNOWN_CORRELATION": unknown, "TOO_SHALLOW": shallow})
