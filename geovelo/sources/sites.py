"""Measured sites and query locations from text files, and their sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.spatial import from_map_grid, project, thinned


def _columns(spark: SparkSession, path: str, sep: str, wanted: dict[int, tuple[str, str]], width: int) -> DataFrame:
    """Columns of a headed delimited file by index, with names and types."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    rows = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    return rows.select([F.trim(f"c{k}").try_cast(t).alias(n) for k, (n, t) in wanted.items()])


def locations(spark: SparkSession, path: str, lon: int = 0, lat: int = 1, sep: str = ",", skip_rows: int = 0) -> DataFrame:
    """(point_id, longitude, latitude, easting, northing) from two columns by index. point_id follows the order of the lines; skip_rows leaves out the first lines of the file. What is missing or no number is null."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"))
    if skip_rows:
        first = lines.orderBy("_at").limit(skip_rows).select("_at")
        lines = lines.join(first, "_at", "left_anti")
    parts = F.split("value", sep if len(sep) == 1 and sep not in "|.^$*+?()[]{}\\" else rf"\Q{sep}\E")
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    rows = lines.where(F.trim("value") != "").select(F.col("_at").alias("point_id"), number(lon).alias("longitude"), number(lat).alias("latitude"))
    return project(rows)


def cpt_sites(spark: SparkSession, path: str) -> DataFrame:
    """Easting, northing, vs30; rows without vs30 are dropped."""
    rows = _columns(spark, path, " ", {0: ("easting", "double"), 1: ("northing", "double"), 2: ("vs30", "double")}, 3)
    return rows.dropna(subset=["vs30"]).withColumn("uncertainty", F.lit(0.5))


def map_grid_sites(spark: SparkSession, path: str, thin: bool = True) -> DataFrame:
    """A table with map grid and NZTM coordinates side by side: the former, thinned to one site a kilometre, or the latter as they are."""
    wanted = {3: ("x", "double"), 4: ("y", "double")} if thin else {5: ("easting", "double"), 6: ("northing", "double")}
    rows = _columns(spark, path, ",", wanted | {7: ("vs30", "double")}, 8).withColumn("uncertainty", F.lit(0.2))
    if not thin:
        return rows
    placed = from_map_grid(rows, "x", "y").drop("x", "y").withColumn("site_id", F.monotonically_increasing_id())
    return thinned(placed).drop("site_id")


def tabbed_sites(spark: SparkSession, path: str) -> DataFrame:
    """Latitude, longitude and vs30 in columns 2 to 4."""
    rows = _columns(spark, path, "\t", {2: ("latitude", "double"), 3: ("longitude", "double"), 4: ("vs30", "double")}, 9)
    return project(rows.dropna(subset=["vs30"])).select("easting", "northing", "vs30", F.lit(0.2).alias("uncertainty"))


def graded_sites(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(station, q, easting, northing, vs30, uncertainty) from a padded, quoted list with comment lines and one header; uncertainty is q/10, or 0.5 for grade 3."""
    parts = F.split("value", ",")
    text = lambda k: F.trim(F.regexp_replace(F.get(parts, F.lit(k)), '"', ""))
    lines = spark.read.text(path).where(~F.ltrim("value").startswith(comment) & (F.trim("value") != ""))
    rows = lines.select(text(0).alias("station"), text(1).try_cast("double").alias("longitude"), text(2).try_cast("double").alias("latitude"), text(3).try_cast("double").alias("vs30"), F.regexp_extract(F.get(parts, F.lit(4)), r'"Q(\d)', 1).try_cast("int").alias("q"))
    graded = rows.where("q IS NOT NULL AND longitude IS NOT NULL").withColumn("uncertainty", uncertainty(F.col("q")))
    return project(graded).select("station", "q", "easting", "northing", "vs30", "uncertainty")


def uncertainty(q):
    return F.when(q == 3, 0.5).otherwise(q / 10)


def reliable(sites: DataFrame) -> DataFrame:
    """Grades 1 and 2, and grade 3 only for stations with names of three characters."""
    return sites.where((F.col("q") != 3) | (F.length("station") == 3))


def union(*sources: DataFrame) -> DataFrame:
    """One table of all sources, columns that a source lacks null. site_id is a hash of the row and of which of its equals it is, so no task sees all rows."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    equals = F.row_number().over(Window.partitionBy(*out.columns).orderBy(F.lit(0)))
    return out.withColumn("_k", equals).withColumn("site_id", F.xxhash64(*out.columns, "_k")).drop("_k")


@dataclass(frozen=True)
class SiteFiles:
    """Paths of the site lists; those of a source that is not read may be missing."""

    map_grid: str | None = None
    tabbed: str | None = None
    graded: str | None = None
    cpt: str | None = None


def load_vs(spark: SparkSession, files: SiteFiles, source: str = "original") -> DataFrame:
    """The measured sites: original is the thinned map-grid list, the tabbed one and the reliable rows of the graded one; cpt is the cone-based list alone."""
    if source == "cpt":
        return union(cpt_sites(spark, files.cpt))
    if source != "original":
        raise ValueError(f"unknown site source {source}")
    given = [(map_grid_sites, files.map_grid), (tabbed_sites, files.tabbed), (lambda s, p: reliable(graded_sites(s, p)), files.graded)]
    return union(*[read(spark, path) for read, path in given if path])


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One header a file, null as NA; fails if path is there unless overwrite."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("nullValue", "NA").csv(path)


def write_raster(raster: DataFrame, path: str, rows_a_band: int = 256, overwrite: bool = False) -> None:
    """Pixels as zstd Parquet, partitioned by bands of rows so that a box reads its bands only."""
    banded = raster.withColumn("band", F.floor(F.col("row") / rows_a_band).cast("int"))
    banded.repartition("band").sortWithinPartitions("row", "col").write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").partitionBy("band").parquet(path)


def read_raster(spark: SparkSession, path: str, first_row: int | None = None, last_row: int | None = None, rows_a_band: int = 256) -> DataFrame:
    """A stored raster, or the rows from first_row to last_row of it; only their bands are read."""
    out = spark.read.parquet(path)
    if first_row is not None:
        out = out.where((F.col("band") >= first_row // rows_a_band) & (F.col("row") >= first_row))
    if last_row is not None:
        out = out.where((F.col("band") <= last_row // rows_a_band) & (F.col("row") <= last_row))
    return out.drop("band")
