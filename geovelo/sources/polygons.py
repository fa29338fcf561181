"""Polygons as text, WKT or GeoJSON, to a table of edges in native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = "array<array<double>>"
_ONE = f"type string, coordinates array<{_RING}>"
_MANY = f"type string, coordinates array<array<{_RING}>>"


def wkt_rings(text: Column) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON, holes included: arrays of points (x, y, ..). Null or EMPTY gives none."""
    ring = lambda r: F.transform(F.split(r, ","), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.cast("double")))
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), ring)


def geojson_rings(text: Column) -> Column:
    """The rings of a Polygon or MultiPolygon geometry; other types have none."""
    kind = F.get_json_object(text, "$.type")
    many = F.flatten(F.from_json(text, _MANY)["coordinates"])
    return F.when(kind == "Polygon", F.from_json(text, _ONE)["coordinates"]).when(kind == "MultiPolygon", many)


def edges(features: DataFrame, rings: Column) -> DataFrame:
    """(gid, feature_ord, x1, y1, x2, y2) of features (gid, feature_ord). A point lies inside by the parity of the edges beside it, so holes and parts
    need no marks; rings that are not closed are, and edges without length are left out."""
    each = features.select("gid", "feature_ord", F.explode(rings).alias("_r")).where(F.size("_r") > 2)
    ends = F.arrays_zip(F.col("_r").alias("a"), F.concat(F.slice("_r", 2, F.size("_r") - 1), F.slice("_r", 1, 1)).alias("b"))
    pairs = each.select("gid", "feature_ord", F.explode(ends).alias("_e"))
    flat = pairs.select("gid", "feature_ord", *[F.col(f"_e.{end}")[k].alias(f"{axis}{n}") for n, end in ((1, "a"), (2, "b")) for k, axis in enumerate("xy")])
    return flat.where("x1 != x2 OR y1 != y2")


def read_polygons(spark: SparkSession, path: str, sep: str = "\t", geojson: bool = False) -> DataFrame:
    """Edges of a headed file of two columns, gid and geometry text; features count in the order of the file's lines."""
    rows = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("quote", "" if sep == "\t" else '"').schema("gid int, geometry string").csv(path)
    return edges(rows.withColumn("feature_ord", F.monotonically_increasing_id()), (geojson_rings if geojson else wkt_rings)(F.col("geometry")))
