"""Whole estimates: site velocity at points or over a grid, and Vs30 from soundings. Each is a lazy plan, but for the correction, which takes its sites while the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, cluster, cpt, kriging, models, profile, raster, spatial, spt
from ..operators.raster import Grid


@dataclass(frozen=True)
class Settings:
    """geology, terrain: off, prior, posterior (from the sites) or posterior_paper."""

    geology: str = "posterior_paper"
    terrain: str = "posterior_paper"
    hybrid: bool = True
    mod6: bool = True
    mod13: bool = True
    by_variance: bool = False
    k: float = -1.0
    clustered: bool = False
    cell: float = 20_000.0


@dataclass(frozen=True)
class Layers:
    """Map layers: polygon edges with categories, and rasters under their grids. slope and coast may be missing: without coast the coast overrides are left out."""

    edges: DataFrame
    terrain: DataFrame
    terrain_grid: Grid
    slope: DataFrame | None = None
    slope_grid: Grid | None = None
    coast: DataFrame | None = None
    coast_grid: Grid | None = None


def located(points: DataFrame, layers: Layers, settings: Settings) -> DataFrame:
    """points plus gid, tid, slope and coast from the layers; columns that points has already stay."""
    out = points
    if "gid" not in out.columns:
        out = spatial.in_polygons(out, layers.edges, settings.cell)
    rasters = [("tid", layers.terrain, layers.terrain_grid), ("slope", layers.slope, layers.slope_grid), ("coast", layers.coast, layers.coast_grid)]
    wanted = [(name, table, grid) for name, table, grid in rasters if name not in out.columns]
    # rasters of one grid are looked up together
    for grid in dict.fromkeys(grid for _, table, grid in wanted if table is not None):
        out = raster.lookup_all(out, raster.stacked({name: table for name, table, own in wanted if table is not None and own == grid}), grid)
    for name, table, _ in wanted:
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.withColumn("tid", F.col("tid").cast("int")) if any(name == "tid" for name, *_ in wanted) else out


def model_tables(sites: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The category table of each model that is on."""
    spark, out = sites.sparkSession, {}
    for model, choice, key in (("geology", settings.geology, "gid"), ("terrain", settings.terrain, "tid")):
        if choice == "posterior":
            prior = models.table(spark, model, "prior")
            out[model] = models.cluster_posterior(prior, cluster.dbscan(sites, key), key) if settings.clustered else models.posterior(prior, sites, key)
        elif choice != "off":
            out[model] = models.table(spark, model, choice)
    return out


def _valued(points: DataFrame, tables: dict[str, DataFrame], settings: Settings, has_coast: bool) -> DataFrame:
    out = points
    if "geology" in tables:
        out = models.assign(out, tables["geology"], "gid", "geology")
        out = models.hybrid(out, settings.mod6) if settings.hybrid else out
        out = models.coast(out, settings.mod6, settings.mod13) if has_coast else out
    return models.assign(out, tables["terrain"], "tid", "terrain") if "terrain" in tables else out


def measured(sites: DataFrame, layers: Layers, settings: Settings = Settings(), cached: list[DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The sites with their categories and model values, and the category table of each model that is on. The sites are cached: models and corrections read them. What is cached is added to cached, for the caller to release."""
    named = sites.withColumnRenamed("site_id", "point_id") if "site_id" in sites.columns else sites
    placed = located(named, layers, settings)
    placed = (placed.withColumnRenamed("point_id", "site_id") if "site_id" in sites.columns else placed).persist()
    tables = model_tables(placed, settings)
    has_coast = layers.coast is not None or "coast" in sites.columns
    known = _valued(placed, tables, settings, has_coast).persist()
    if cached is not None:
        cached += [placed, known]
    return known, tables


def modelled(points: DataFrame, layers: Layers, tables: dict[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    """points plus categories and each model's velocity and sigma."""
    return _valued(located(points, layers, settings), tables, settings, layers.coast is not None or "coast" in points.columns)


def combined(points: DataFrame, settings: Settings = Settings(), infix: str = "") -> DataFrame:
    """points plus <infix>vs30 and <infix>stdv of both models together."""
    mean, sd = models.combine(*[F.col(f"{m}_{infix}{c}") for m in ("geology", "terrain") for c in ("vs30", "stdv")], settings.by_variance, settings.k)
    return points.withColumns({f"{infix}vs30": mean, f"{infix}stdv": sd})


def corrected(points: DataFrame, known: DataFrame, tables: dict[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    """Modelled points plus each model corrected near the measured sites (.._mvn_..), and the combined columns if both models are on."""
    out = points
    for model in tables:
        out = kriging.correct(out, known, model)
    return combined(combined(out, settings), settings, "mvn_") if len(tables) == 2 else out


def estimate(points: DataFrame, sites: DataFrame, layers: Layers, settings: Settings = Settings()) -> DataFrame:
    """points plus categories, each model's velocity and sigma, those corrected near sites (.._mvn_..), and the combined ones.

    points: (point_id, easting, northing); pixels of a grid are points too. Combined columns exist only if both models are on.
    """
    known, tables = measured(sites, layers, settings)
    return corrected(modelled(points, layers, tables, settings), known, tables, settings)


def estimate_grid(grid: Grid, sites: DataFrame, layers: Layers, settings: Settings = Settings()) -> DataFrame:
    """estimate over all pixels of a grid, with row and col."""
    return estimate(raster.pixels(sites.sparkSession, grid), sites, layers, settings)


def cpt_profiles(soundings: DataFrame, names: list[str], average_shallow: bool = False) -> DataFrame:
    """Truncated profiles (cpt_id, vs_correlation, ..) of filtered, unit-corrected soundings under each named correlation."""
    return profile.truncate(cpt.profiles(cpt.guess_units(cpt.valid(soundings)), names), ("cpt_id", "vs_correlation"), average_shallow)


def spt_profiles(boreholes: DataFrame, names: list[str]) -> DataFrame:
    """Truncated profiles (spt_id, vs_correlation, ..)."""
    return profile.truncate(spt.profiles(boreholes, names), ("spt_id", "vs_correlation"))


def profile_vs30(truncated: DataFrame, keys: tuple[str, ...], vs30_correlations: list[str], layered: bool | str = False, shallow_is_null: bool = False) -> DataFrame:
    """(keys, vs30_correlation, z, vsz, vs30, vs30_sd): every profile under every named Vs30 correlation. A profile too shallow for one is an error, or, with shallow_is_null, has null there."""
    each = profile.vsz(truncated, keys, layered).withColumn("vs30_correlation", F.explode(F.array(*[F.lit(x) for x in vs30_correlations])))
    return profile.vs30(each, shallow_is_null)


def checked_cpt_vs30(soundings: DataFrame, names: list[str], vs30_correlations: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results, errors): profile_vs30() of all soundings that can be used, and (cpt_id, vs_correlation, vs30_correlation, condition, message, code) of what can't. One bad sounding doesn't end the job."""
    keys = ("cpt_id", "vs_correlation")
    good, unusable = checks.cpt(soundings)
    averages = profile.vsz(cpt_profiles(good, names), keys).withColumn("vs30_correlation", F.explode(F.array(*[F.lit(x) for x in vs30_correlations])))
    deep, shallow = checks.vs30(averages, keys)
    return profile.vs30(deep), unusable.unionByName(shallow, allowMissingColumns=True).select(*keys, "vs30_correlation", "condition", "message", "code")
