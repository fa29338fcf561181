"""Correlations over a stream of sounding rows. Only those that need a single row run here; stresses need the rows above and stay in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.cpt_correlations import CPT_CORRELATIONS
from ..functions.numeric import finite

STATELESS = ("mcgann_2015", "mcgann_2018")


def read(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of Parquet files with the sounding schema as they arrive."""
    return spark.readStream.schema(schema.SOUNDING).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def velocities(rows: DataFrame, names: tuple[str, ...] = STATELESS) -> DataFrame:
    """(cpt_id, vs_correlation, pos, depth, vs, vs_sd) of rows with positive qc and fs; no state is kept."""
    wrong = [x for x in names if x not in STATELESS]
    if wrong:
        raise ValueError(f"{wrong} need the rows above")
    each = []
    for name in names:
        vs, sd = CPT_CORRELATIONS[name][0]()
        each.append(F.struct(F.lit(name).alias("vs_correlation"), finite(vs).alias("vs"), sd.cast("double").alias("vs_sd")))
    return rows.where("qc > 0 AND fs > 0").withColumn("_p", F.explode(F.array(*each))).select("cpt_id", "_p.vs_correlation", "pos", "depth", "_p.vs", "_p.vs_sd")
