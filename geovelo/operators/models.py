"""Category models: tables of mean velocity and sigma, their updates from measured sites, and overrides by slope and coast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp

# Mean and sigma of categories 1, 2, 3, ...
GEOLOGY_PRIOR = ((161, 0.522), (198, 0.314), (239, 0.867), (323, 0.365), (326, 0.135), (339, 0.647), (360, 0.338), (376, 0.380), (399, 0.305), (448, 0.432), (453, 0.512), (455, 0.545), (458, 0.761), (635, 0.995), (750, 0.641))
GEOLOGY_POSTERIOR = (
    (162.892120019443, 0.301033220758108), (272.512711921894, 0.280305955290694), (199.502400319993, 0.438753673163297), (271.050623687222, 0.243486579272276), (326, 0.5),
    (204.373998521848, 0.232196981798137), (246.6138371423, 0.344601218802256), (472.749388885179, 0.354562104171167), (399, 0.5), (197.472849225266, 0.202629769603115),
    (453, 0.512), (455, 0.545), (335.279503497185, 0.602886888230288), (635, 0.995), (690.974348966211, 0.446036993981441),
)
TERRAIN_PRIOR = ((519, 0.3521), (393, 0.4161), (547, 0.4695), (459, 0.3540), (402, 0.3136), (345, 0.2800), (388, 0.4161), (374, 0.3249), (497, 0.3516), (349, 0.2800), (328, 0.2736), (297, 0.2931), (500, 0.5), (209, 0.1749), (363, 0.2800), (246, 0.2206))
TERRAIN_POSTERIOR = (
    (519, 0.5), (393, 0.5), (547, 0.5), (459, 0.5), (323.504047697085, 0.407430975749267), (300.639538792274, 0.306594194335118), (535.786417756242, 0.380788655293195), (514.970575501527, 0.380788655293195),
    (284.470950299338, 0.360555127546399), (317.368444092771, 0.33166247903554), (266.870166096091, 0.4), (297, 0.5), (216.62368022053, 0.254950975679639), (241.80869962047, 0.307482445914323), (198.64481157494, 0.205256370217328), (202.125866002814, 0.206820130727133),
)
TABLES = {("geology", "prior"): GEOLOGY_PRIOR, ("geology", "posterior_paper"): GEOLOGY_POSTERIOR, ("terrain", "prior"): TERRAIN_PRIOR, ("terrain", "posterior_paper"): TERRAIN_POSTERIOR}
# Category, log10 slope from and to, velocity from and to, factor on sigma.
HYBRID = ((2, -1.85, -1.22, 242, 418, 0.4888), (3, -2.70, -1.35, 171, 228, 0.7103), (4, -3.44, -0.88, 252, 275, 0.9988), (6, -3.56, -0.93, 183, 239, 0.9348))
SLOPE_NO_DATA, FLATTEST = -9999.0, 1e-9
# Category, velocity near the coast and far from it, between 8 and 20 km.
COAST = {4: (240.0, 500.0), 10: (197.0, 500.0)}


def table(spark: SparkSession, model: str, choice: str = "prior") -> DataFrame:
    """(id, vs30, stdv): 15 or 16 rows."""
    rows = TABLES[(model, choice)]
    return spark.createDataFrame([(k, float(v), float(s)) for k, (v, s) in enumerate(rows, 1)], "id int, vs30 double, stdv double")


def assign(points: DataFrame, model: DataFrame, id_column: str, prefix: str) -> DataFrame:
    """points plus <prefix>_vs30 and <prefix>_stdv of their category; null for category 0, 255, null or unknown. model has one row a category, 255 at most, so it may be broadcast."""
    own = model.where("id BETWEEN 1 AND 254").select(F.col("id").alias(id_column), F.col("vs30").alias(f"{prefix}_vs30"), F.col("stdv").alias(f"{prefix}_stdv"))
    return points.join(F.broadcast(own), id_column, "left")


def _by_id(gid: Column, values: dict[int, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in values.items():
        out = out.when(gid == k, v)
    return out


def hybrid(points: DataFrame, mod6: bool = True, slope: str = "slope", gid: str = "gid", prefix: str = "geology") -> DataFrame:
    """Velocities of four categories replaced by one that follows the slope, interpolated in log10 of both and held at the ends; their sigmas reduced. With mod6 category 4 keeps its velocity here. Slopes of 0, no data or null count as FLATTEST."""
    flat = F.col(slope).isNull() | F.col(slope).isin(0.0, SLOPE_NO_DATA)
    lg = F.log10(F.when(flat, FLATTEST).otherwise(F.col(slope)))
    speed = {k: F.pow(F.lit(10.0), a + (b - a) * clamp((lg - lo) / (hi - lo), 0, 1)) for k, lo, hi, v0, v1, _ in HYBRID if not (mod6 and k == 4) for a, b in [(_lg(v0), _lg(v1))]}
    factor = {k: F.lit(f) for k, *_, f in HYBRID}
    vs, sd, known = F.col(f"{prefix}_vs30"), F.col(f"{prefix}_stdv"), F.col(f"{prefix}_vs30").isNotNull()
    return points.withColumns({f"{prefix}_vs30": F.when(known, F.coalesce(_by_id(F.col(gid), speed), vs)), f"{prefix}_stdv": sd * F.coalesce(_by_id(F.col(gid), factor), F.lit(1.0))})


def _lg(x: float) -> float:
    import math

    return math.log10(x)


def coast(points: DataFrame, mod6: bool = True, mod13: bool = True, distance: str = "coast", gid: str = "gid", prefix: str = "geology") -> DataFrame:
    """Velocities of category 4 (mod6) and 10 (mod13) replaced by one that rises from 8 to 20 km off the coast. Without a distance they become null."""
    out = F.col(f"{prefix}_vs30")
    for k, on in ((4, mod6), (10, mod13)):
        near, far = COAST[k]
        if on:
            out = F.when(F.col(gid) == k, clamp(near + (far - near) * (F.col(distance) - 8000) / 12000, near, far)).otherwise(out)
    return points.withColumn(f"{prefix}_vs30", out)


def combine(a: Column, sd_a: Column, b: Column, sd_b: Column, by_variance: bool = False, k: float = -1.0) -> tuple[Column, Column]:
    """(mean, sigma) of two log-normal estimates: a mixture of equal parts, or of parts that go with variance to the power -k."""
    if by_variance:
        ma, mb = F.pow(sd_a * sd_a, F.lit(-k)), F.pow(sd_b * sd_b, F.lit(-k))
        wa, wb = ma / F.nullif(ma + mb, F.lit(0.0)), mb / F.nullif(ma + mb, F.lit(0.0))
    else:
        wa = wb = F.lit(0.5)
    mean = F.log(a) * wa + F.log(b) * wb
    off_a, off_b = F.log(a) - mean, F.log(b) - mean
    return F.exp(mean), F.sqrt(wa * (off_a * off_a + sd_a * sd_a) + wb * (off_b * off_b + sd_b * sd_b))


def posterior(model: DataFrame, sites: DataFrame, id_column: str, n_prior: int = 3, min_sigma: float = 0.5, legacy_offset: bool = False) -> DataFrame:
    """model updated by the sites of each category, the prior counting as n_prior measurements.

    Taking sites one after the other has the closed form ln mean = (n ln prior + sum ln vs30) / (n + N) and variance =
    (n sigma^2 + sum u^2) / (n + N), whatever their order: one aggregate. legacy_offset updates category id + 1 by id's sites.
    """
    own = sites.where(F.col(id_column).isNotNull() & (F.col(id_column) != 255)).withColumn("id", F.col(id_column) + (1 if legacy_offset else 0))
    sums = own.groupBy("id").agg(F.sum(F.log("vs30")).alias("_ln"), F.sum(F.col("uncertainty") * F.col("uncertainty")).alias("_u"), F.count(F.lit(1)).alias("_n"))
    s = F.greatest(F.col("stdv"), F.lit(min_sigma))
    n = n_prior + F.coalesce("_n", F.lit(0))
    mean = F.exp((n_prior * F.log("vs30") + F.coalesce("_ln", F.lit(0.0))) / n)
    sd = F.sqrt((n_prior * s * s + F.coalesce("_u", F.lit(0.0))) / n)
    return model.join(sums, "id", "left").select("id", F.when(F.col("_n").isNull(), F.col("vs30")).otherwise(mean).alias("vs30"), F.when(F.col("_n").isNull(), s).otherwise(sd).alias("stdv"))


def cluster_posterior(model: DataFrame, sites: DataFrame, id_column: str) -> DataFrame:
    """model with the mean and spread of ln vs30 over clusters of sites; a site without a cluster (-1) is one of its own. Categories without sites keep the prior."""
    one = F.when(F.col("cluster") == -1, F.concat(F.lit("n"), F.col("site_id"))).otherwise(F.col("cluster").cast("string"))
    ln = sites.select(F.col(id_column).alias("id"), one.alias("_c"), F.log("vs30").alias("_ln"))
    cluster = Window.partitionBy("id", "_c")
    sized = ln.withColumn("_size", F.count(F.lit(1)).over(cluster))
    sums = sized.groupBy("id").agg(F.sum(F.col("_ln") / F.col("_size")).alias("_sum"), F.sum(F.lit(1.0) / F.col("_size")).alias("_clusters"))
    mean = sums.select("id", (F.col("_sum") / F.rint("_clusters")).alias("_mean"), F.rint("_clusters").alias("_n"))
    off = F.col("_ln") - F.col("_mean")
    spread = sized.join(mean, "id").groupBy("id").agg(F.first("_mean").alias("_mean"), F.sqrt(F.sum(off * off / F.col("_size") / F.col("_n"))).alias("_sd"))
    return model.join(spread, "id", "left").select("id", F.coalesce(F.exp("_mean"), F.col("vs30")).alias("vs30"), F.coalesce("_sd", "stdv").alias("stdv"))
