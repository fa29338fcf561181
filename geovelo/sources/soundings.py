"""Soundings and profiles from files and JSON, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema

_STEM = r"([^/]+?)(\.[^./]*)?$"
_CPT_JSON = "name string, depth array<double>, Qc array<double>, Fs array<double>, u array<double>, is_kpa boolean, gwl double, nar double"
_SPT_JSON = "name string, depth array<double>, N array<double>, hammer_type string, borehole_diameter double, energy_ratio double, soil_type array<string>, N60 array<double>"
_PROFILE_JSON = "name string, vs_correlation string, vs30_correlation string, layered string, max_depth double, vs array<double>, vs_sd array<double>, depth array<double>"


def _stem() -> Column:
    """File name without folders and ending."""
    return F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), _STEM, 1)


def _place() -> list[Column]:
    """The file's path and where in it a row stands, so that files of one name in two folders stay apart and rows keep their order."""
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]


def _numbered(rows: DataFrame, depth: str, strict: bool) -> DataFrame:
    """pos in the order of the file's rows, and, if strict, an error for negative depths; else they are left to operators.checks."""
    sound = F.when(F.col(depth) < 0, F.raise_error(F.lit("depths must not be negative"))).otherwise(F.col(depth)) if strict else F.col(depth)
    return rows.withColumn("depth", sound).withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("block", "at")))


def read_cpt(spark: SparkSession, path: str, gwl: float = 1.0, nar: float = 0.8, kpa: bool = False, strict: bool = True) -> DataFrame:
    """(name, cpt_id, pos, depth, qc, fs, u, gwl, nar) of headed CSV files, columns by position. kpa brings qc, fs and u to MPa. cpt_id is a hash of the path."""
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(schema.CPT_FILE).csv(path)
    unit = 1000.0 if kpa else 1.0
    named = rows.select(_stem().alias("name"), "depth", *[(F.col(c) / unit).alias(c) for c in ("qc", "fs", "u")], *_place())
    return _numbered(named, "depth", strict).select("name", F.xxhash64("path").alias("cpt_id"), "pos", "depth", "qc", "fs", "u", F.lit(gwl).alias("gwl"), F.lit(nar).alias("nar"))


def read_spt(spark: SparkSession, path: str, hammer: str | None = None, diameter: float = 150.0, energy_ratio: float | None = None, soil: str | None = None, strict: bool = True) -> DataFrame:
    """(name, spt_id, pos, depth, n, soil, hammer, diameter, energy_ratio) of headed CSV files with Depth, NValue and maybe Soil. A row's soil stands before the given one and that before Clay; no hammer is Auto."""
    raw = spark.read.option("header", True).csv(path)
    kind = F.col("Soil") if "Soil" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(_stem().alias("name"), F.col("Depth").cast("double").alias("depth"), F.col("NValue").cast("double").alias("n"), F.coalesce(kind, F.lit(soil), F.lit("Clay")).alias("soil"), *_place())
    return _numbered(rows, "depth", strict).select("name", F.xxhash64("path").alias("spt_id"), "pos", "depth", "n", "soil", F.coalesce(F.lit(hammer), F.lit("Auto")).alias("hammer"), F.lit(float(diameter)).alias("diameter"), F.lit(energy_ratio).cast("double").alias("energy_ratio"))


def read_profile(spark: SparkSession, path: str, layered: bool = False, strict: bool = True) -> DataFrame:
    """(name, pos, depth, vs, vs_sd, layered) of headed CSV files with Depth, Vs and Vs_SD."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(_stem().alias("name"), F.col("Depth").cast("double").alias("depth"), F.col("Vs").cast("double").alias("vs"), F.col("Vs_SD").cast("double").alias("vs_sd"), F.lit(layered).alias("layered"), *_place())
    return _numbered(rows, "depth", strict).select("name", "pos", "depth", "vs", "vs_sd", "layered")


def _in_order(*columns: tuple[str, str]) -> list[Column]:
    rows = F.array_sort(F.collect_list(F.struct("pos", *[c for c, _ in columns])))
    field = lambda c: lambda r: r[c]
    return [F.transform(rows, field(c)).alias(n) for c, n in columns]


def cpt_to_json(soundings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, json), one row a sounding. by: more columns that tell soundings apart; rows that are dealt by one of them are not shuffled again."""
    one = soundings.groupBy(*by, "name").agg(*_in_order(("depth", "depth"), ("qc", "Qc"), ("fs", "Fs"), ("u", "u")), F.first("gwl").alias("gwl"), F.first("nar").alias("nar"))
    return one.select("name", F.to_json(F.struct("name", "depth", "Qc", "Fs", "u", "gwl", "nar")).alias("json"))


def cpt_from_json(texts: DataFrame) -> DataFrame:
    """The soundings of (json); values are taken as they are, in MPa."""
    j = texts.select(F.from_json("json", _CPT_JSON).alias("j")).select("j.*")
    rows = j.select("name", "gwl", "nar", F.posexplode(F.arrays_zip("depth", "Qc", "Fs", "u")).alias("k", "r"))
    return rows.select("name", F.xxhash64("name").alias("cpt_id"), (F.col("k") + 1).alias("pos"), "r.depth", F.col("r.Qc").alias("qc"), F.col("r.Fs").alias("fs"), "r.u", "gwl", "nar")


def spt_to_json(boreholes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, json), one row a borehole; n60 is kept if there. by as in cpt_to_json."""
    extra = [("n60", "N60")] if "n60" in boreholes.columns else []
    one = boreholes.groupBy(*by, "name").agg(*_in_order(("depth", "depth"), ("n", "N"), ("soil", "soil_type"), *extra), F.first("hammer").alias("hammer_type"), F.first("diameter").alias("borehole_diameter"), F.first("energy_ratio").alias("energy_ratio")).drop(*by)
    return one.select("name", F.to_json(F.struct(*one.columns)).alias("json"))


def spt_from_json(texts: DataFrame) -> DataFrame:
    j = texts.select(F.from_json("json", _SPT_JSON).alias("j")).select("j.*")
    rows = j.select("name", "hammer_type", "borehole_diameter", "energy_ratio", F.posexplode(F.arrays_zip("depth", "N", "soil_type", "N60")).alias("k", "r"))
    return rows.select("name", F.xxhash64("name").alias("spt_id"), (F.col("k") + 1).alias("pos"), "r.depth", F.col("r.N").alias("n"), F.col("r.soil_type").alias("soil"), F.col("hammer_type").alias("hammer"), F.col("borehole_diameter").alias("diameter"), "energy_ratio", F.col("r.N60").alias("n60"))


def profile_to_json(profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, json); layered is written as the words True and False, missing correlations as empty strings. by as in cpt_to_json."""
    keys = ["name", "vs_correlation", "vs30_correlation"]
    rows = profiles.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in keys[1:]})
    one = rows.groupBy(*by, *keys).agg(*_in_order(("depth", "depth"), ("vs", "vs"), ("vs_sd", "vs_sd")), F.when(F.first("layered"), "True").otherwise("False").alias("layered"), F.max("depth").alias("max_depth")).drop(*by)
    return one.select("name", F.to_json(F.struct(*one.columns)).alias("json"))


def profile_from_json(texts: DataFrame) -> DataFrame:
    j = texts.select(F.from_json("json", _PROFILE_JSON).alias("j")).select("j.*")
    rows = j.select("name", F.nullif(F.col("vs_correlation"), F.lit("")).alias("vs_correlation"), F.nullif(F.col("vs30_correlation"), F.lit("")).alias("vs30_correlation"), (F.col("layered") == "True").alias("layered"), F.posexplode(F.arrays_zip("depth", "vs", "vs_sd")).alias("k", "r"))
    return rows.select("name", "vs_correlation", "vs30_correlation", "layered", (F.col("k") + 1).alias("pos"), "r.depth", "r.vs", "r.vs_sd")


def profile_table(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("depth").alias("Depth"), F.col("vs").alias("Vs"), F.col("vs_sd").alias("Vs_SD"))


def write_profiles(profiles: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV files in one folder a profile."""
    rows = profiles.select(F.col("name").alias("profile"), F.col("depth").alias("Depth"), F.col("vs").alias("Vs"), F.col("vs_sd").alias("Vs_SD"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).partitionBy("profile").csv(path)
