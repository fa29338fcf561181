"""A whole run from files to files: measured sites, locations or a grid, layers, models, correction, tables and rasters out."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, raster
from ..operators.raster import Grid
from ..sources import sites as sources
from ..sources import staging, tiles
from . import pipeline

#: Category written where there is none.
NO_CATEGORY = 255
_MODEL = ("vs30", "stdv")


@dataclass(frozen=True)
class Locations:
    """A delimited file of places; without one a run covers the grid."""

    path: str
    lon: int = 0
    lat: int = 1
    sep: str = " "
    skip_rows: int = 0


@dataclass(frozen=True)
class Options:
    """source: original or cpt; with cpt and a posterior model the update goes by clusters of sites. tiles: rasters as GeoTIFF blocks, not as Parquet."""

    out: str
    files: sources.SiteFiles
    source: str = "original"
    overwrite: bool = False
    tiles: bool = False
    locations: Locations | None = None
    grid: Grid = field(default_factory=lambda: Grid.over(1_060_050, 2_120_050, 4_730_050, 6_250_050, 100, 100))
    settings: pipeline.Settings = pipeline.Settings()


def _points_table(out: DataFrame, models: list[str]) -> DataFrame:
    """Columns in the order of the point table; both models' together only if both are there."""
    both = [*_MODEL, "mvn_vs30", "mvn_stdv"]
    own = {"geology": "gid", "terrain": "tid"}
    columns = [c for m in models for c in (F.coalesce(own[m], F.lit(NO_CATEGORY)).alias(own[m]), *[F.col(f"{m}_{c}") for c in both])]
    return out.select("longitude", "latitude", "easting", "northing", *columns, *(both if len(models) == 2 else []))


def _sites_table(known: DataFrame, models: list[str], settings: pipeline.Settings) -> DataFrame:
    graded = known
    for name, kind in (("station", "string"), ("q", "double")):
        graded = graded.withColumn(name, (F.col(name) if name in known.columns else F.lit(None)).cast(kind))
    own, groups = {"geology": "gid", "terrain": "tid"}, []
    for m in models:
        if settings.clustered and getattr(settings, m) == "posterior":
            groups.append(f"{own[m][0]}cluster")
            graded = cluster.dbscan(graded, own[m]).withColumnRenamed("cluster", groups[-1])
    columns = [c for m in models for c in (F.coalesce(own[m], F.lit(NO_CATEGORY)).alias(own[m]), *[F.col(f"{m}_{c}") for c in _MODEL])]
    return graded.select("easting", "northing", "vs30", "uncertainty", "station", "q", *columns, *groups)


def _manifest(spark: SparkSession, options: Options, layers: pipeline.Layers) -> dict:
    """What a run goes by: its options, and the state of all files that it reads."""
    told, tables = asdict(options), [layers.edges, layers.terrain, layers.slope, layers.coast]
    read = staging.inputs(spark, *told["files"].values(), options.locations and options.locations.path, *[f for t in tables if t is not None for f in t.inputFiles()])
    grids = [g and asdict(g) for g in (layers.terrain_grid, layers.slope_grid, layers.coast_grid)]
    return {"options": {k: v for k, v in told.items() if k != "overwrite"}, "grids": grids, "inputs": read}


def run(spark: SparkSession, options: Options, layers: pipeline.Layers) -> DataFrame:
    """Writes estimates (Parquet, all columns), measured_sites.csv, and vs30points.csv or one raster a model (geology, geology_mvn, .., combined, combined_mvn: vs30, stdv) under options.out; gives the estimates back.

    The folder appears when all of it is done; one that holds something is an error before any work, unless overwrite. A run that ended early is taken up by the next one with
    the same options and input files: outputs that were finished are not made again. Layers that don't come from files count by their grids alone.
    """
    staged = staging.Staged(spark, options.out, _manifest(spark, options, layers), options.overwrite)
    settings = replace(options.settings, clustered=options.settings.clustered or options.source == "cpt")
    sites = sources.load_vs(spark, options.files, options.source)
    cached: list[DataFrame] = []
    try:
        known, tables = pipeline.measured(sites, layers, settings, cached)
        models = list(tables)
        place = options.locations
        points = raster.pixels(spark, options.grid) if place is None else sources.locations(spark, place.path, place.lon, place.lat, place.sep, place.skip_rows)
        out = pipeline.corrected(pipeline.modelled(points, layers, tables, settings), known, tables, settings)
        path = staged.output("estimates", lambda p: out.write.mode("overwrite").parquet(p))
        stored = spark.read.schema(out.schema).parquet(path)
        staged.output("measured_sites.csv", lambda p: sources.write_csv(_sites_table(known, models, settings), p, True))
        if place is not None:
            staged.output("vs30points.csv", lambda p: sources.write_csv(_points_table(stored, models), p, True))
        else:
            write = _tiles_writer(options.grid) if options.tiles else lambda band, p: sources.write_raster(band, p, overwrite=True)
            for name, prefix in [(m, f"{m}_") for m in models] + ([("combined", "")] if len(models) == 2 else []):
                for infix in ("", "mvn_"):
                    band = stored.select("row", "col", *[F.col(f"{prefix}{infix}{c}").alias(c) for c in _MODEL])
                    staged.output(f"{name}{'_mvn' if infix else ''}", lambda p, band=band: write(band, p))
    finally:
        for table in cached:
            table.unpersist()
    staged.commit()
    return spark.read.schema(out.schema).parquet(f"{options.out}/estimates")


def _tiles_writer(grid: Grid):
    return lambda band, path: tiles.write_tiles(band, grid, path, overwrite=True)
