"""One query an operator, over fixture tables made of the driver's tables, and the same in SQL.

Floating results are rounded the same way on both sides, since the engines' transcendental functions differ in the last place.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..functions import spt_correlations as sc
from ..functions import vs30_correlations as v30
from ..functions.numeric import significant
from ..operators import checks, cluster, cpt, ensemble, kriging, models, profile, raster, spatial, spt
from ..shared import shared_dir
from ..sources import polygons as polygon_sources
from ..sources import sites as site_sources
from ..sources import soundings as sounding_sources
from ..sources import tiles as tile_files
from . import api, pipeline
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ALL_CPT = ["mcgann_2015", "mcgann_2018", "andrus_2007_holocene", "andrus_2007_pleistocene", "andrus_2007_tertiary_age_cooper_marl", "robertson_2009", "hegazy_2006"]
NATIVE = ["mcgann_2015", "mcgann_2018"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return (F.floor(x * float(10**digits) + 0.5) / float(10**digits)).alias(name or c)


def _s(x: str, name: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits} AS {name}"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- soundings -------------------------------------------------------------------------------------------------------

SND, SND_FS, SND_IC = fx.soundings_sql(), fx.soundings_sql(fs=0.01), fx.soundings_sql(1.0, 0.01)
VALID = "v AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY cpt_id ORDER BY pos) AS INTEGER) AS pos) FROM snd WHERE qc > 0 AND fs > 0)"
STRESS = (
    "w1 AS (SELECT *, qc + u * (1 - 0.8::DOUBLE) AS qt FROM v)",
    "w2 AS (SELECT *, CASE WHEN qc <= 0 OR fs <= 0 THEN 0.00981 * 1.9::DOUBLE ELSE greatest(0.014::DOUBLE, 9.80665::DOUBLE / 1000 * (0.27::DOUBLE * log10(100 * fs / qt) + 0.36::DOUBLE * log10(qt / 0.1::DOUBLE) + 1.236::DOUBLE)) END AS gamma FROM w1)",
    "w3 AS (SELECT *, gamma * (depth - coalesce(lag(depth) OVER (PARTITION BY cpt_id ORDER BY pos), 0)) AS step FROM w2)",
    "w4 AS (SELECT *, sum(step) OVER (PARTITION BY cpt_id ORDER BY pos) AS total_stress, CASE WHEN pos > 1 AND depth >= 1.0 THEN 0.00981::DOUBLE * (depth - 1.0) ELSE 0 END AS u0 FROM w3)",
    "st AS (SELECT *, total_stress - u0 AS eff_stress, qt - total_stress AS net, 100 * fs / nullif(qt - total_stress, 0) AS fr FROM w4)",
)


def _fixed_point(steps: int) -> list[str]:
    """The solve unrolled; each step leaves settled rows as they are."""
    out = ["s0 AS (SELECT *, 0.5::DOUBLE AS n, 0::DOUBLE AS qtn, 0::DOUBLE AS ic, false AS done FROM st)"]
    for k in range(steps):
        out += [
            f"a{k} AS (SELECT *, net / 0.1::DOUBLE * CASE WHEN eff_stress > 0 THEN least(1.7::DOUBLE, power(0.1::DOUBLE / eff_stress, n)) END AS q2 FROM s{k})",
            f"b{k} AS (SELECT *, CASE WHEN q2 > 0 AND fr > 0 THEN sqrt(power(3.47::DOUBLE - log10(q2), 2) + power(log10(fr) + 1.22::DOUBLE, 2)) END AS i2 FROM a{k})",
            f"c{k} AS (SELECT *, CASE WHEN i2 IS NOT NULL THEN least(1::DOUBLE, 0.381::DOUBLE * i2 + 0.05::DOUBLE * (eff_stress / 0.1::DOUBLE) - 0.15::DOUBLE) END AS n2 FROM b{k})",
            f"s{k + 1} AS (SELECT * EXCLUDE (n, qtn, ic, done, q2, i2, n2), CASE WHEN done THEN n ELSE n2 END AS n, CASE WHEN done THEN qtn ELSE q2 END AS qtn, CASE WHEN done THEN ic ELSE i2 END AS ic, done OR coalesce(abs(n - n2) < 0.01, true) AS done FROM c{k})",
        ]
    return out


SOLVED = [*STRESS, *_fixed_point(8), "soil AS (SELECT * FROM s8)"]


@query(_with(SND) + """SELECT cpt_id, rint_(min_by(depth, pos)) AS z_min, rint_(max_by(depth, pos)) AS z_max, rint_(max_by(depth, pos) - min_by(depth, pos)) AS z_spread,
  CAST(count(*) FILTER (NOT (qc > 0 AND fs > 0)) AS INTEGER) AS n_removed, CAST(sum(pos - 1) FILTER (NOT (qc > 0 AND fs > 0)) AS BIGINT) AS sum_removed FROM snd GROUP BY cpt_id""".replace("rint_(", "round_even(100 * (").replace(") AS z_", "), 0) / 100 AS z_"))  # fmt: skip
def cpt_filter_info(spark, sf):
    out = cpt.info(fx.soundings(spark, sf))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("cpt_id", "z_min", "z_max", "z_spread", F.size("removed").alias("n_removed"), F.when(F.size("removed") > 0, total).alias("sum_removed"))


_UNITS = "x AS (SELECT cpt_id, pos, depth, qc, CASE WHEN cpt_id % 2 = 0 THEN fs * 1000 ELSE fs END AS fs, CASE WHEN cpt_id % 3 = 0 THEN 1e5 + u ELSE u END AS u FROM v)"


@query(_with(SND, VALID, _UNITS, "m AS (SELECT *, max(CASE WHEN pos = 51 THEN u END) OVER p AS mu, CASE WHEN count(*) OVER p > 100 THEN max(CASE WHEN pos = 101 THEN fs END) OVER p ELSE max(CASE WHEN pos = 6 THEN fs END) OVER p END AS mf FROM x WINDOW p AS (PARTITION BY cpt_id))")
       + f"SELECT cpt_id, pos, {_s('CASE WHEN coalesce(mu < 10, true) THEN u WHEN mu / 1000 < 10 THEN u / 1000 ELSE u / 1000 / 1000 END', 'u')}, {_s('CASE WHEN mf > 1 THEN fs / 1000 ELSE fs END', 'fs')} FROM m")
def cpt_units(spark, sf):
    rows = cpt.valid(fx.soundings(spark, sf))
    mixed = rows.withColumns({"fs": F.when(F.col("cpt_id") % 2 == 0, F.col("fs") * 1000).otherwise(F.col("fs")), "u": F.when(F.col("cpt_id") % 3 == 0, 1e5 + F.col("u")).otherwise(F.col("u"))})
    return cpt.guess_units(mixed).select("cpt_id", "pos", _r("u"), _r("fs"))


@query(_with(SND, VALID, *STRESS) + f"SELECT cpt_id, pos, {_s('qt', 'qt')}, {_s('gamma', 'gamma')} FROM st")
def cpt_gamma(spark, sf):
    return cpt.stresses(cpt.valid(fx.soundings(spark, sf))).select("cpt_id", "pos", _r("qt"), _r("gamma"))


@query(_with(SND, VALID, *STRESS) + f"SELECT cpt_id, pos, {_s('total_stress', 'total_stress')}, {_s('u0', 'u0')}, {_s('eff_stress', 'eff_stress')} FROM st")
def cpt_stress(spark, sf):
    return cpt.stresses(cpt.valid(fx.soundings(spark, sf))).select("cpt_id", "pos", _r("total_stress"), _r("u0"), _r("eff_stress"))


@query(_with(SND_FS, VALID, *SOLVED) + f"SELECT cpt_id, pos, {_s('qtn', 'qtn')}, {_s('ic', 'ic')}, {_s('n', 'n')}, {_s('CASE WHEN fr IS NOT NULL THEN fr END', 'fr', 4)} FROM soil")
def cpt_ic_qtn(spark, sf):
    return cpt.soil_parameters(cpt.valid(fx.soundings(spark, sf, fs=0.01))).select("cpt_id", "pos", _r("qtn"), _r("ic"), _r("n"), _r("fr", 4))


def _andrus(scale: str, by_qt: float, by_ic: float, by_depth: float, spread: int) -> tuple[str, str]:
    vs = f"{scale} * power(CASE WHEN qt <= 0 THEN 1e-4 ELSE qt END * 1000, {by_qt}::DOUBLE) * power(depth, {by_depth}::DOUBLE)" + (f" * power(ic, {by_ic}::DOUBLE)" if by_ic else "")
    return vs, f"CASE WHEN vs = 0 THEN 0 ELSE ln({spread}::DOUBLE / vs + 1) END"


_QTN = "CASE WHEN qtn <= 0 THEN 1e-4 ELSE qtn END"
CPT_SQL = {
    "mcgann_2015": ("18.4::DOUBLE * power(qc * 1000, 0.144::DOUBLE) * power(fs * 1000, 0.083::DOUBLE) * power(depth, 0.278::DOUBLE)", "CASE WHEN depth <= 5 THEN 0.162::DOUBLE WHEN depth < 10 THEN 0.216::DOUBLE - 0.0108::DOUBLE * depth ELSE 0.108 END"),
    "mcgann_2018": ("103.6::DOUBLE * power(qc * 1000, 0.0074::DOUBLE) * power(fs * 1000, 0.130::DOUBLE) * power(depth, 0.253::DOUBLE)", "0.2367::DOUBLE"),
    "andrus_2007_holocene": _andrus("2.27::DOUBLE", 0.412, 0.989, 0.033, 22),
    "andrus_2007_pleistocene": _andrus("(2.62::DOUBLE * 1.12::DOUBLE)", 0.395, 0.912, 0.124, 45),
    "andrus_2007_tertiary_age_cooper_marl": _andrus("13::DOUBLE", 0.382, 0, 0.099, 67),
    "robertson_2009": (f"sqrt(power(10::DOUBLE, 0.55::DOUBLE * ic + 1.68::DOUBLE) * {_QTN}) * power(eff_stress / 0.1::DOUBLE, 0.25::DOUBLE)", "0.2::DOUBLE"),
    "hegazy_2006": (f"0.0831::DOUBLE * {_QTN} * power(eff_stress / 0.1::DOUBLE, 0.25::DOUBLE) * exp(1.786::DOUBLE * ic)", "0.2::DOUBLE"),
}


def _cpt_profiles_sql(names: list[str]) -> list[str]:
    each = " UNION ALL ".join(f"SELECT cpt_id, '{n}' AS vs_correlation, pos, depth, vs, {CPT_SQL[n][1]} AS vs_sd FROM (SELECT *, {CPT_SQL[n][0]} AS vs FROM soil)" for n in names)
    return [SND_IC, VALID, *SOLVED, f"p AS ({each})"]


def _correlation(name: str):
    def run(spark, sf):
        return cpt.profiles(cpt.valid(fx.soundings(spark, sf, 1.0, 0.01)), [name]).select("cpt_id", "pos", _r("vs", 4), _r("vs_sd"))

    run.__name__ = "vs_" + {"andrus_2007_tertiary_age_cooper_marl": "andrus_marl"}.get(name, name.replace("_2007", "").removesuffix("_2009").removesuffix("_2006"))
    return query(_with(*_cpt_profiles_sql([name])) + f"SELECT cpt_id, pos, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')} FROM p")(run)


for _name in ALL_CPT:
    _correlation(_name)

# --- boreholes -------------------------------------------------------------------------------------------------------

N60 = """n6 AS (SELECT *, round_even(100 * (n * CASE WHEN energy_ratio IS NOT NULL THEN energy_ratio / 60 WHEN hammer = 'Safety' THEN 0.7::DOUBLE WHEN hammer = 'Standard' THEN 0.5 ELSE 0.8 END
    * CASE WHEN diameter BETWEEN 65 AND 115 THEN 1::DOUBLE WHEN diameter = 200 THEN 1.15 ELSE 1.05 END * CASE WHEN depth < 3 THEN 0.75::DOUBLE WHEN depth < 4 THEN 0.8 WHEN depth < 6 THEN 0.85 WHEN depth < 10 THEN 0.95 ELSE 1 END), 0) / 100 AS n60 FROM bh)"""


def _spt_sql(name: str) -> list[str]:
    rows = sc.SPT_CORRELATIONS[name]
    value = lambda k: "CASE soil " + " ".join(f"WHEN '{s}' THEN {r[k]}::DOUBLE" for s, r in rows.items() if s) + f" ELSE {rows[None][k]} END"
    return [
        fx.BOREHOLES_SQL, N60,
        f"q1 AS (SELECT *, depth + 0.3048::DOUBLE AS below, {', '.join(f'{value(k)} AS k{k}' for k in range(9))} FROM n6 WHERE n60 > 0)",
        "q2 AS (SELECT *, CASE WHEN below > 2 THEN 2 * k4 + (below - 2) * (k5 - 9.81::DOUBLE) ELSE below * k4 END AS stress FROM q1)",
        "q3 AS (SELECT *, CASE WHEN stress <= 200 THEN k6 - k7 * ln(stress) ELSE k8 END AS spread, exp(k0 + k1 * ln(n60) + k2 * ln(stress)) AS vs FROM q2)",
        "sp AS (SELECT *, sqrt(k3 * k3 + spread * spread) AS vs_sd FROM q3)",
    ]


@query(_with(fx.BOREHOLES_SQL, N60) + f"SELECT spt_id, pos, {_s('n60', 'n60', 2)} FROM n6")
def spt_n60(spark, sf):
    return spt.n60(fx.boreholes(spark, sf)).select("spt_id", "pos", _r("n60", 2))


def _borehole(name: str):
    def run(spark, sf):
        return spt.profiles(fx.boreholes(spark, sf), [name]).select("spt_id", "pos", _r("vs", 4), _r("vs_sd"), _r("eff_stress", 4))

    run.__name__ = "vs_" + name.split("_")[0]
    # every N is positive here, so no row is renumbered
    return query(_with(*_spt_sql(name)) + f"SELECT spt_id, pos, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')}, {_s('stress', 'eff_stress', 4)} FROM sp")(run)


for _name in sc.SPT_CORRELATIONS:
    _borehole(_name)

# --- profiles --------------------------------------------------------------------------------------------------------


def _profiles(spark, sf, names=NATIVE) -> DataFrame:
    return cpt.profiles(cpt.valid(fx.soundings(spark, sf, 1.0, 0.01)), names)


KEYS = ("cpt_id", "vs_correlation")
TRUNCATED = (
    "t1 AS (SELECT *, CAST(least(floor(max(depth) OVER (PARTITION BY cpt_id, vs_correlation)), 30) AS INTEGER) AS z FROM p)",
    "t2 AS (SELECT *, lag(depth) OVER o AS pd, lag(vs) OVER o AS pv, lag(vs_sd) OVER o AS ps FROM t1 WINDOW o AS (PARTITION BY cpt_id, vs_correlation ORDER BY pos))",
    "t3 AS (SELECT *, depth > z AND coalesce(pd <= z, false) AND pd <> z AS moved FROM t2)",
    "t AS (SELECT cpt_id, vs_correlation, pos, z, CASE WHEN moved THEN z ELSE depth END AS depth, CASE WHEN moved AND (depth + pd) / 2 >= z THEN pv ELSE vs END AS vs, CASE WHEN moved AND (depth + pd) / 2 >= z THEN ps ELSE vs_sd END AS vs_sd FROM t3 WHERE depth <= z OR moved)",
)
NATIVE_SQL = [*_cpt_profiles_sql(NATIVE), *TRUNCATED]


def _layers_sql(table: str = "t", layered: bool = False, name: str = "l") -> str:
    top, bot = ("lag(depth) OVER o", "depth") if layered else ("(depth + lag(depth) OVER o) / 2", "(depth + lead(depth) OVER o) / 2")
    return f"{name} AS (SELECT *, coalesce({top}, 0) AS z_top, coalesce({bot}, depth) AS z_bot FROM {table} WINDOW o AS (PARTITION BY cpt_id, vs_correlation ORDER BY pos))"


VSZ = "vz AS (SELECT cpt_id, vs_correlation, max(z) AS z, max(z) / sum((z_bot - z_top) / vs) AS vsz FROM l GROUP BY ALL)"


@query(_with(*NATIVE_SQL) + f"SELECT cpt_id, vs_correlation, pos, z, {_s('depth', 'depth', 4)}, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')} FROM t")
def profile_truncate(spark, sf):
    return profile.truncate(_profiles(spark, sf), KEYS).select(*KEYS, "pos", "z", _r("depth", 4), _r("vs", 4), _r("vs_sd"))


def _layer_query(layered: bool):
    def run(spark, sf):
        return profile.layers(profile.truncate(_profiles(spark, sf), KEYS), KEYS, "vs", layered).select(*KEYS, "pos", _r("z_top"), _r("z_bot"), _r("vs", 4))

    run.__name__ = "midpoint_layered" if layered else "midpoint_layers"
    return query(_with(*NATIVE_SQL, _layers_sql(layered=layered)) + f"SELECT cpt_id, vs_correlation, pos, {_s('z_top', 'z_top')}, {_s('z_bot', 'z_bot')}, {_s('vs', 'vs', 4)} FROM l")(run)


_layer_query(False)
_layer_query(True)


@query(_with(*NATIVE_SQL, _layers_sql(), "n AS (SELECT *, row_number() OVER (PARTITION BY cpt_id, vs_correlation ORDER BY pos) - 1 AS k FROM l)")
       + f"SELECT cpt_id, vs_correlation, CAST(2 * k AS INTEGER) AS point, {_s('z_top', 'depth')}, {_s('vs', 'vs', 4)} FROM n UNION ALL SELECT cpt_id, vs_correlation, CAST(2 * k + 1 AS INTEGER), {_s('z_bot', 'depth')}, {_s('vs', 'vs', 4)} FROM n")
def midpoint_points(spark, sf):
    return profile.midpoints(profile.truncate(_profiles(spark, sf), KEYS), KEYS).select(*KEYS, F.col("point").cast("int").alias("point"), _r("depth"), _r("vs", 4))


@query(_with(*NATIVE_SQL) + f"SELECT cpt_id, vs_correlation, pos, {_s('vs * exp(-vs_sd)', 'vs_below', 4)}, {_s('vs * exp(vs_sd)', 'vs_above', 4)} FROM t")
def sigma_band(spark, sf):
    return profile.sigma_band(profile.truncate(_profiles(spark, sf), KEYS)).select(*KEYS, "pos", _r("vs_below", 4), _r("vs_above", 4))


@query(_with(*NATIVE_SQL, _layers_sql(), VSZ) + f"SELECT cpt_id, vs_correlation, z, {_s('vsz', 'vsz')} FROM vz")
def vsz(spark, sf):
    return profile.vsz(profile.truncate(_profiles(spark, sf), KEYS), KEYS).select(*KEYS, "z", _r("vsz"))


_COEFFICIENTS = "co(vs30_correlation, z, a, b, c, sigma) AS (VALUES " + ", ".join(
    [f"('boore_2011', {z}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {s}::DOUBLE)" for z, a, b, c, s in v30.BOORE_2011] + [f"('boore_2004', {z}, {a}::DOUBLE, {b}::DOUBLE, NULL, {s}::DOUBLE)" for z, a, b, s in v30.BOORE_2004]
) + ")"


def _vs30_sql(names: list[str]) -> list[str]:
    listed = ", ".join(f"('{n}')" for n in names)
    return [
        _layers_sql(), VSZ, _COEFFICIENTS, f"wanted(vs30_correlation) AS (VALUES {listed})",
        "g AS (SELECT vz.*, w.vs30_correlation, a, b, c, sigma, log10(vsz) AS lg, log10(ln(vsz)) AS ll, ln(vsz) AS lv FROM vz CROSS JOIN wanted w LEFT JOIN co ON co.vs30_correlation = w.vs30_correlation AND co.z = vz.z)",
        "h AS (SELECT *, CASE WHEN z = 30 THEN vsz ELSE power(10::DOUBLE, a + b * lg + coalesce(c, 0) * lg * lg) END AS vs30, CASE WHEN z = 30 THEN 0 WHEN c IS NULL THEN sigma ELSE sqrt(sigma * sigma + power((b * power(10::DOUBLE, b * ll) + 2 * c * ll * power(10::DOUBLE, c * ll * ll)) / lv, 2)) END AS vs30_sd FROM g)",
    ]


def _short_sql(names: list[str] = NATIVE) -> list[str]:
    """Profiles of soundings of different depths, a third of them above 30 m."""
    return [fx.soundings_sql(1.0, 0.01, True), *_cpt_profiles_sql(names)[1:], *TRUNCATED]


def _short(spark, sf, names=NATIVE) -> DataFrame:
    return profile.truncate(cpt.profiles(cpt.valid(fx.soundings(spark, sf, 1.0, 0.01, True)), names), KEYS)


def _vs30_query(name: str):
    def run(spark, sf):
        return pipeline.profile_vs30(_short(spark, sf), KEYS, [name], shallow_is_null=True).select(*KEYS, "z", _r("vsz"), _r("vs30"), _r("vs30_sd"))

    run.__name__ = f"vs30_{name}"
    return query(_with(*_short_sql(), *_vs30_sql([name])) + f"SELECT cpt_id, vs_correlation, z, {_s('vsz', 'vsz')}, {_s('vs30', 'vs30')}, {_s('vs30_sd', 'vs30_sd')} FROM h")(run)


for _name in v30.VS30_CORRELATIONS:
    _vs30_query(_name)

# --- ensembles -------------------------------------------------------------------------------------------------------

_WEIGHTS = "wt AS (SELECT 'vs' AS kind, 'mcgann_2015' AS key, 0.6::DOUBLE AS weight UNION ALL SELECT 'vs', 'mcgann_2018', 0.4 UNION ALL SELECT 'vs30', 'boore_2004', 0.7 UNION ALL SELECT 'vs30', 'boore_2011', 0.31 UNION ALL SELECT 'profile', CAST(s_suppkey AS VARCHAR), 1::DOUBLE / count(*) OVER () FROM supplier)"
_NORMAL = "nw AS (SELECT kind, key, weight / sum(weight) OVER (PARTITION BY kind) AS weight FROM wt)"


def _weights(spark, sf) -> DataFrame:
    fixed = spark.createDataFrame([("vs", "mcgann_2015", 0.6), ("vs", "mcgann_2018", 0.4), ("vs30", "boore_2004", 0.7), ("vs30", "boore_2011", 0.31)], "kind string, key string, weight double")
    names = fx.read(spark, sf, "supplier").select(F.lit("profile").alias("kind"), F.col("s_suppkey").cast("string").alias("key"))
    return fixed.unionByName(ensemble.equal_weights(names))


@query(_with(_WEIGHTS, _NORMAL) + f"SELECT kind, key, {_s('weight', 'weight', 9)} FROM nw")
def weights_normalised(spark, sf):
    return ensemble.normalised(_weights(spark, sf)).select("kind", "key", _r("weight", 9))


@query(_with(*_short_sql(), *_vs30_sql(["boore_2004", "boore_2011"]), _WEIGHTS, _NORMAL,
             "x AS (SELECT h.*, a.weight * b.weight * d.weight AS w FROM h JOIN nw a ON a.kind = 'profile' AND a.key = CAST(cpt_id AS VARCHAR) JOIN nw b ON b.kind = 'vs' AND b.key = vs_correlation JOIN nw d ON d.kind = 'vs30' AND d.key = vs30_correlation)",
             "m AS (SELECT sum(w * vs30) AS mean FROM x)")
       + f"SELECT {_s('any_value(mean)', 'vs30')}, {_s('ln(sqrt(sum(w * vs30_sd * vs30_sd + w * (vs30 - mean) * (vs30 - mean))))', 'vs30_sd')} FROM x, m")
def weighted_vs30(spark, sf):
    each = pipeline.profile_vs30(_short(spark, sf), KEYS, ["boore_2004", "boore_2011"]).withColumn("name", F.col("cpt_id").cast("string"))
    return ensemble.weighted_vs30(ensemble.weighted(each, _weights(spark, sf))).select(_r("vs30"), _r("vs30_sd"))


def _average_sql(table: str = "t", *extra: str) -> str:
    return (_with(*_short_sql(), *extra, _layers_sql(table), _WEIGHTS, _NORMAL,
             "e AS (SELECT l.*, cpt_id % 5 AS grp, a.weight * b.weight AS w, min(depth) OVER q AS d0, lead(pos) OVER (PARTITION BY cpt_id, vs_correlation ORDER BY pos) IS NULL AS final FROM l JOIN nw a ON a.kind = 'profile' AND a.key = CAST(cpt_id AS VARCHAR) JOIN nw b ON b.kind = 'vs' AND b.key = vs_correlation WINDOW q AS (PARTITION BY cpt_id, vs_correlation))",
             "f AS (SELECT *, CAST(ceil(greatest(z_top, d0) / 0.005::DOUBLE) AS BIGINT) AS s0, CAST(CASE WHEN final THEN floor(z_bot / 0.005::DOUBLE) ELSE ceil(z_bot / 0.005::DOUBLE) - 1 END AS BIGINT) AS s1 FROM e WHERE vs <> 0)",
             "c AS (SELECT grp, s AS step, sum(w * vs) / sum(w) AS vs, sqrt(sum(w * vs_sd * vs_sd) / sum(w)) AS vs_sd FROM f, unnest(generate_series(s0, s1)) u(s) WHERE s0 <= s1 GROUP BY grp, s)",
             "d AS (SELECT *, lag(step) OVER o AS ls, lag(vs) OVER o AS lv, lag(vs_sd) OVER o AS lsd FROM c WINDOW o AS (PARTITION BY grp ORDER BY step))",
             "pts AS (SELECT grp, step, 2 AS k, step * 0.005::DOUBLE AS depth, vs, vs_sd FROM d UNION ALL SELECT grp, step, 0, 0, vs, vs_sd FROM d WHERE ls IS NULL AND step > 0 UNION ALL SELECT grp, step, 0, (ls * 0.005::DOUBLE + step * 0.005::DOUBLE) / 2, lv, lsd FROM d WHERE step - ls > 1 UNION ALL SELECT grp, step, 1, (ls * 0.005::DOUBLE + step * 0.005::DOUBLE) / 2, vs, vs_sd FROM d WHERE step - ls > 1)")
       + f"SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY step, k) - 1 AS INTEGER) AS point, {_s('depth', 'depth')}, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')} FROM pts")


def _average(spark, sf, rows: DataFrame) -> DataFrame:
    named = rows.withColumns({"name": F.col("cpt_id").cast("string"), "vs30_correlation": F.lit(None).cast("string"), "grp": F.col("cpt_id") % 5})
    curve = ensemble.average_profile(ensemble.weighted(named, _weights(spark, sf)), KEYS, ("grp",))
    return curve.select("grp", "point", _r("depth"), _r("vs", 4), _r("vs_sd"))


@query(_average_sql())
def profile_average(spark, sf):
    return _average(spark, sf, _short(spark, sf))


@query(_average_sql("tz", "tz AS (SELECT * REPLACE (CASE WHEN pos % 11 = 3 THEN 0 ELSE vs END AS vs) FROM t)"))
def profile_average_zeros(spark, sf):
    """Layers of velocity 0 are left out; the gaps between the others are bridged."""
    return _average(spark, sf, _short(spark, sf).withColumn("vs", F.when(F.col("pos") % 11 == 3, 0.0).otherwise(F.col("vs"))))


@query("SELECT n_name AS key, r_name AS kind, " + _s("n_nationkey / 100.0::DOUBLE * (r_regionkey + 1)", "weight", 9) + " FROM nation JOIN region ON r_regionkey = n_regionkey")
def section_weights(spark, sf):
    sections = fx.read(spark, sf, "region").select(F.col("r_name").alias("kind"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))
    region = fx.read(spark, sf, "region").select("r_name", F.col("r_regionkey").alias("n_regionkey"))
    keys = fx.read(spark, sf, "nation").join(region, "n_regionkey").select(F.col("n_name").alias("key"), F.col("r_name").alias("kind"), (F.col("n_nationkey") / 100.0).alias("weight"))
    return ensemble.section_weights(sections, keys).select("key", "kind", _r("weight", 9))


@query("WITH s AS (SELECT s_suppkey AS id, (1 + s_suppkey * 7919 % 99991) / 7.0::DOUBLE AS x FROM supplier), p AS (SELECT *, power(10::DOUBLE, ceil(log10(abs(x))) - 4) AS w FROM s) SELECT id, " + _s("floor(x / w + 0.5) * w", "shown") + " FROM p")
def display_rounding(spark, sf):
    k = F.col("s_suppkey")
    return fx.read(spark, sf, "supplier").select(k.alias("id"), _r(significant((1 + k * 7919 % 99991) / 7.0), name="shown"))


@query(_with(*NATIVE_SQL, "a AS (SELECT *, avg(vs) FILTER (depth BETWEEN 2.5 AND 3.5) OVER (PARTITION BY cpt_id, vs_correlation) AS m FROM t)") + f"SELECT cpt_id, vs_correlation, pos, {_s('CASE WHEN depth <= 3 THEN m ELSE vs END', 'vs', 4)} FROM a")
def shallow_average(spark, sf):
    return profile.truncate(_profiles(spark, sf), KEYS, average_shallow=True).select(*KEYS, "pos", _r("vs", 4))


@query(_with(*NATIVE_SQL) + "SELECT DISTINCT cpt_id || '_' || vs_correlation AS label FROM t UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier")
def profile_labels(spark, sf):
    named = profile.truncate(_profiles(spark, sf), KEYS).select(ensemble.label(F.col("cpt_id").cast("string"), F.col("vs_correlation")).alias("label")).distinct()
    plain = fx.read(spark, sf, "supplier").select(ensemble.label(F.col("s_suppkey").cast("string"), F.lit(None).cast("string")).alias("label"))
    return named.unionAll(plain)


# --- category models -------------------------------------------------------------------------------------------------


def _table_sql(name: str, rows) -> str:
    return f"{name}(id, m, s) AS (VALUES " + ", ".join(f"({k}, {v}::DOUBLE, {s}::DOUBLE)" for k, (v, s) in enumerate(rows, 1)) + ")"


def _lookup_query(model: str, key: str):
    rows = models.TABLES[(model, "posterior_paper")]

    def run(spark, sf):
        out = models.assign(fx.points(spark, sf), models.table(spark, model, "posterior_paper"), key, model)
        return out.select("point_id", F.col(f"{model}_vs30").alias("vs30"), F.col(f"{model}_stdv").alias("stdv"))

    run.__name__ = f"model_lookup_{model}"
    return query(_with(fx.POINTS_SQL, _table_sql("mo", rows)) + f"SELECT point_id, m AS vs30, s AS stdv FROM pt LEFT JOIN mo ON mo.id = pt.{key}")(run)


_lookup_query("geology", "gid")
_lookup_query("terrain", "tid")
_GEO = [fx.POINTS_SQL, _table_sql("mo", models.GEOLOGY_POSTERIOR), "gv AS (SELECT pt.*, m AS geology_vs30, s AS geology_stdv FROM pt LEFT JOIN mo ON mo.id = pt.gid)"]
_HYBRID = "hy(id, lo, hi, v0, v1, f) AS (VALUES " + ", ".join("(" + ", ".join([str(r[0]), *[f"{x}::DOUBLE" for x in r[1:]]]) + ")" for r in models.HYBRID) + ")"


def _geology(spark, sf, key="gid") -> DataFrame:
    return models.assign(fx.points(spark, sf), models.table(spark, "geology", "posterior_paper"), "gid", "geology")


@query(_with(*_GEO, _HYBRID, "x AS (SELECT *, log10(CASE WHEN slope = 0 OR slope = -9999 THEN 1e-9 ELSE slope END) AS lg FROM gv LEFT JOIN hy ON hy.id = gv.gid)")
       + f"SELECT point_id, {_s('CASE WHEN f IS NULL OR gid = 4 THEN geology_vs30 ELSE power(10::DOUBLE, log10(v0) + (log10(v1) - log10(v0)) * greatest(0, least(1, (lg - lo) / (hi - lo)))) END', 'vs30')}, {_s('geology_stdv * coalesce(f, 1)', 'stdv')} FROM x")
def hybrid_slope(spark, sf):
    return models.hybrid(_geology(spark, sf)).select("point_id", _r("geology_vs30", name="vs30"), _r("geology_stdv", name="stdv"))


@query(_with(*_GEO) + f"SELECT point_id, {_s('CASE gid WHEN 4 THEN greatest(240, least(500, 240 + 260::DOUBLE * (coast - 8000) / 12000)) WHEN 10 THEN greatest(197, least(500, 197 + 303::DOUBLE * (coast - 8000) / 12000)) ELSE geology_vs30 END', 'vs30')} FROM gv")
def coast_override(spark, sf):
    return models.coast(_geology(spark, sf)).select("point_id", _r("geology_vs30", name="vs30"))


_BOTH = [fx.POINTS_SQL, _table_sql("mo", models.GEOLOGY_POSTERIOR), _table_sql("te", models.TERRAIN_POSTERIOR), "b0 AS (SELECT point_id, mo.m AS a, mo.s AS sa, te.m AS b, te.s AS sb FROM pt LEFT JOIN mo ON mo.id = gid LEFT JOIN te ON te.id = tid)"]


def _combine_query(name: str, by_variance: bool):
    wa = "sa * sa / (sa * sa + sb * sb)" if by_variance else "0.5::DOUBLE"

    def run(spark, sf):
        both = models.assign(_geology(spark, sf), models.table(spark, "terrain", "posterior_paper"), "tid", "terrain")
        mean, sd = models.combine(*[F.col(c) for c in ("geology_vs30", "geology_stdv", "terrain_vs30", "terrain_stdv")], by_variance)
        return both.select("point_id", _r(mean, name="vs30"), _r(sd, name="stdv"))

    run.__name__ = name
    sql = _with(*_BOTH, f"b1 AS (SELECT *, {wa} AS wa FROM b0)", "b2 AS (SELECT *, ln(a) * wa + ln(b) * (1 - wa) AS mean FROM b1)")
    return query(sql + f"SELECT point_id, {_s('exp(mean)', 'vs30')}, {_s('sqrt(wa * (power(ln(a) - mean, 2) + sa * sa) + (1 - wa) * (power(ln(b) - mean, 2) + sb * sb))', 'stdv')} FROM b2")(run)


_combine_query("combine_equal", False)
_combine_query("combine_stdv_weight", True)


def _posterior_query(name: str, legacy: bool):
    def run(spark, sf):
        out = models.posterior(models.table(spark, "geology"), fx.sites(spark, sf), "gid", legacy_offset=legacy)
        return out.select("id", _r("vs30"), _r("stdv"))

    run.__name__ = name
    sql = _with(fx.SITES_SQL, _table_sql("mo", models.GEOLOGY_PRIOR), f"a AS (SELECT gid + {int(legacy)} AS id, sum(ln(vs30)) AS l, sum(uncertainty * uncertainty) AS u, count(*) AS n FROM site GROUP BY 1)")
    return query(sql + f"SELECT mo.id, {_s('CASE WHEN n IS NULL THEN m ELSE exp((3 * ln(m) + l) / (3 + n)) END', 'vs30')}, {_s('sqrt((3 * power(greatest(s, 0.5::DOUBLE), 2) + coalesce(u, 0)) / (3 + coalesce(n, 0)))', 'stdv')} FROM mo LEFT JOIN a ON a.id = mo.id")(run)


_posterior_query("bayes_posterior", False)
_posterior_query("bayes_posterior_legacy", True)

# --- clustering ------------------------------------------------------------------------------------------------------

_EPS = 40_000
_CLUSTERS = [
    fx.SITES_SQL, f"pr AS (SELECT a.gid, a.site_id AS a, b.site_id AS b FROM site a JOIN site b ON a.gid = b.gid WHERE sqrt(power(a.easting - b.easting, 2) + power(a.northing - b.northing, 2)) <= {_EPS})",
    "core AS (SELECT a AS site_id FROM pr GROUP BY a HAVING count(*) >= 5)", "ln AS (SELECT a, b FROM pr WHERE a IN (SELECT site_id FROM core) AND b IN (SELECT site_id FROM core))",
    "reach AS (SELECT site_id AS a, site_id AS b FROM core UNION SELECT reach.a, ln.b FROM reach JOIN ln ON ln.a = reach.b)", "lab AS (SELECT a AS site_id, min(b) AS label FROM reach GROUP BY a)",
    "edge2 AS (SELECT pr.a AS site_id, min(label) AS label FROM pr JOIN lab ON lab.site_id = pr.b GROUP BY pr.a)",
    "cl AS (SELECT s.*, coalesce(lab.label, edge2.label) AS label FROM site s LEFT JOIN lab USING (site_id) LEFT JOIN edge2 USING (site_id))",
    "cc AS (SELECT *, CAST(CASE WHEN label IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY gid ORDER BY label NULLS LAST) - 1 END AS INTEGER) AS cluster FROM cl)",
]


@query("WITH RECURSIVE " + ",\n".join(_CLUSTERS) + " SELECT site_id, cluster FROM cc")
def cluster_sites(spark, sf):
    return cluster.dbscan(fx.sites(spark, sf), "gid", eps=float(_EPS)).select("site_id", "cluster")


@query("WITH RECURSIVE " + ",\n".join([*_CLUSTERS, _table_sql("mo", models.GEOLOGY_PRIOR),
        "x AS (SELECT gid AS id, ln(vs30) AS l, count(*) OVER (PARTITION BY gid, CASE WHEN cluster = -1 THEN 'n' || site_id ELSE CAST(cluster AS VARCHAR) END) AS size FROM cc)",
        "y AS (SELECT id, sum(l / size) / round(sum(1::DOUBLE / size)) AS mean, round(sum(1::DOUBLE / size)) AS n FROM x GROUP BY id)",
        "zz AS (SELECT x.id, any_value(mean) AS mean, sqrt(sum(power(l - mean, 2) / size / n)) AS sd FROM x JOIN y USING (id) GROUP BY x.id)"])
       + f" SELECT mo.id, {_s('coalesce(exp(mean), m)', 'vs30')}, {_s('coalesce(sd, s)', 'stdv')} FROM mo LEFT JOIN zz ON zz.id = mo.id")
def cluster_posterior(spark, sf):
    clustered = cluster.dbscan(fx.sites(spark, sf), "gid", eps=float(_EPS))
    return models.cluster_posterior(models.table(spark, "geology"), clustered, "gid").select("id", _r("vs30"), _r("stdv"))


# --- rasters and places ----------------------------------------------------------------------------------------------

_G, _T = fx.GRID, fx.FINE


@query(_with(fx.POINTS_SQL, fx.RASTER_SQL) + f"SELECT point_id, value FROM pt LEFT JOIN ras ON ras.col = floor((easting - {_G.x0}) / {_G.dx}) AND ras.row = floor((northing - {_G.y0}) / ({_G.dy}))")
def raster_lookup(spark, sf):
    return raster.lookup(fx.points(spark, sf), fx.raster(spark, sf), _G, "value").select("point_id", "value")


_PIXELS = f"px AS (SELECT CAST(i // {_T.nx} AS INTEGER) AS row, CAST(i % {_T.nx} AS INTEGER) AS col, {_T.x0}::DOUBLE + (i % {_T.nx} + 0.5::DOUBLE) * {_T.dx}::DOUBLE AS x, {_T.y0}::DOUBLE + (i // {_T.nx} + 0.5::DOUBLE) * ({_T.dy}::DOUBLE) AS y FROM range({_T.nx * _T.ny}) t(i))"


@query(_with(fx.RASTER_SQL, _PIXELS) + f"SELECT px.row, px.col, value FROM px LEFT JOIN ras ON ras.col = floor((x - {_G.x0}) / {_G.dx}) AND ras.row = floor((y - {_G.y0}) / ({_G.dy}))")
def raster_resample(spark, sf):
    return raster.resample(fx.raster(spark, sf), _G, _T)


_INSIDE = "count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1"


@query(_with(fx.POLYGONS_SQL, _PIXELS, f"hit AS (SELECT row, col, gid FROM px, edge GROUP BY ALL HAVING {_INSIDE})") + "SELECT px.row, px.col, CAST(max(gid) AS DOUBLE) AS value FROM px LEFT JOIN hit USING (row, col) GROUP BY ALL")
def rasterise(spark, sf):
    return raster.rasterise(fx.polygons(spark, sf), _T, 10_000.0).withColumn("value", F.col("value").cast("double"))


@query(_with(fx.POLYGONS_SQL, fx.POINTS_SQL, f"hit AS (SELECT point_id, e.gid FROM (SELECT point_id, easting AS x, northing AS y FROM pt) q, edge e GROUP BY ALL HAVING {_INSIDE})") + "SELECT pt.point_id, CAST(min(hit.gid) AS DOUBLE) AS gid FROM pt LEFT JOIN hit USING (point_id) GROUP BY ALL")
def point_in_polygon(spark, sf):
    return spatial.in_polygons(fx.points(spark, sf).drop("gid"), fx.polygons(spark, sf), 10_000.0).select("point_id", F.col("gid").cast("double").alias("gid"))


@query(_with(fx.LAND_SQL, "sea AS (SELECT x, y FROM land WHERE value = 0)")
       + f"SELECT l.row, l.col, {_s('least(20000, min(sqrt(power(l.x - s.x, 2) + power(l.y - s.y, 2))))', 'distance', 3)} FROM land l, sea s WHERE l.value = 1 GROUP BY l.row, l.col")
def coast_distance(spark, sf):
    return raster.coast_distance(fx.land(spark, sf), _G).select("row", "col", _r("distance", 3))


#: From c (id, lon, lat) to d, and eastings and northings from d.
_NZTM = ("k AS (SELECT 1 / 298.257222101::DOUBLE AS f), kk AS (SELECT f / (2 - f) AS n FROM k)",
         "a AS (SELECT id, sin(radians(lat)) AS s, radians(lon - 173) AS l, 2 * sqrt(n) / (1 + n) AS e, n FROM c, kk)", "b AS (SELECT id, l, n, sinh(atanh(s) - e * atanh(e * s)) AS t FROM a)",
         "d AS (SELECT id, n, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta, 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * 0.9996::DOUBLE AS r, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM b)")
_ON_NZTM = f"SELECT id, {_s('1600000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta))', 'easting', 3)}, {_s('10000000 + r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta))', 'northing', 3)} FROM d"


def _times(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """The product of two complex numbers as SQL."""
    return f"(({a[0]}) * ({b[0]}) - ({a[1]}) * ({b[1]}))", f"(({a[0]}) * ({b[1]}) + ({a[1]}) * ({b[0]}))"


def _powers(z: tuple[str, str], terms: list[complex]) -> tuple[str, str]:
    """sum of terms[k] * z^(k + 1)."""
    told = lambda c: (f"{c.real!r}::DOUBLE", f"{c.imag!r}::DOUBLE")
    out = _times(z, told(terms[-1]))
    for c in reversed(terms[:-1]):
        out = _times((f"{out[0]} + {told(c)[0]}", f"{out[1]} + {told(c)[1]}"), z)
    return out


def _map_grid_sql() -> list[str]:
    """c (id, lon, lat) from g (id, x, y) on the map grid: an inverse series, two Newton steps, and the move to the newer datum."""
    pj, z, t = projection, ("zr", "zi"), ("tr", "ti")
    guess = _powers(z, list(pj.NZMG_C))
    top, low = _powers(t, [k * b for k, b in enumerate(pj.NZMG_B)]), _powers(t, [(k + 2) * b for k, b in enumerate(pj.NZMG_B[1:])])
    steps = [f"g0 AS (SELECT id, (y - {pj.NZMG_N}::DOUBLE) / {pj.NZMG_A}::DOUBLE AS zr, (x - {pj.NZMG_E}::DOUBLE) / {pj.NZMG_A}::DOUBLE AS zi FROM g)", f"t0 AS (SELECT *, {guess[0]} AS tr, {guess[1]} AS ti FROM g0)"]
    for k in range(2):
        steps += [f"q{k} AS (SELECT *, {top[0]} + zr AS ur, {top[1]} + zi AS ui, {low[0]} + {pj.NZMG_B[0].real!r}::DOUBLE AS lr, {low[1]} AS li FROM t{k})", f"t{k + 1} AS (SELECT id, zr, zi, (ur * lr + ui * li) / (lr * lr + li * li) AS tr, (ui * lr - ur * li) / (lr * lr + li * li) AS ti FROM q{k})"]
    latitude = " + ".join(f"{d!r}::DOUBLE * power(tr, {k})" for k, d in enumerate(pj.NZMG_D, 1))
    e2, g2 = f"{pj.NZMG_FLAT * (2 - pj.NZMG_FLAT)!r}::DOUBLE", f"{pj.FLAT * (2 - pj.FLAT)!r}::DOUBLE"
    dx, dy, dz, rx, ry, rz, m = [*pj.SHIFT[:3], *[math.radians(r / 3600) for r in pj.SHIFT[3:6]], 1 + pj.SHIFT[6] * 1e-6]
    return [
        *steps, f"o AS (SELECT id, radians({pj.LON0} + degrees(ti)) AS la, radians({pj.NZMG_LAT} + ({latitude}) * 1e5::DOUBLE / 3600) AS ph FROM t2)", f"v AS (SELECT *, {pj.NZMG_A}::DOUBLE / sqrt(1 - {e2} * sin(ph) * sin(ph)) AS v FROM o)",
        f"p AS (SELECT id, v * cos(ph) * cos(la) AS x, v * cos(ph) * sin(la) AS y, v * (1 - {e2}) * sin(ph) AS z FROM v)",
        f"s AS (SELECT id, {dx} + {m!r}::DOUBLE * (x - {rz!r}::DOUBLE * y + {ry!r}::DOUBLE * z) AS x, {dy} + {m!r}::DOUBLE * ({rz!r}::DOUBLE * x + y - {rx!r}::DOUBLE * z) AS y, {dz} + {m!r}::DOUBLE * (-({ry!r}::DOUBLE) * x + {rx!r}::DOUBLE * y + z) AS z FROM p)",
        f"w AS (SELECT *, sqrt(x * x + y * y) AS p, {pj.A * (1 - pj.FLAT)!r}::DOUBLE AS b FROM s)", f"u AS (SELECT *, atan2(z * {pj.A}::DOUBLE, p * b) AS u FROM w)",
        f"c AS (SELECT id, degrees(atan2(y, x)) AS lon, degrees(atan2(z + {g2} / (1 - {g2}) * b * power(sin(u), 3), p - {g2} * {pj.A}::DOUBLE * power(cos(u), 3))) AS lat FROM u)",
    ]


@query(_with("g AS (SELECT c_custkey AS id, CAST(2400000 + c_custkey * 7919 % 500000 AS DOUBLE) AS x, CAST(5500000 + c_custkey * 104729 % 1100000 AS DOUBLE) AS y FROM customer)", *_map_grid_sql(), *_NZTM) + _ON_NZTM)
def project_map_grid(spark, sf):
    """From the older map grid."""
    k = F.col("c_custkey")
    placed = fx.read(spark, sf, "customer").select(k.alias("id"), (2_400_000 + k * 7919 % 500_000).cast("double").alias("x"), (5_500_000 + k * 104729 % 1_100_000).cast("double").alias("y"))
    return spatial.from_map_grid(placed, "x", "y").select("id", _r("easting", 3), _r("northing", 3))


@query(_with("c AS (SELECT c_custkey AS id, 166.5::DOUBLE + c_custkey % 1200 / 100.0::DOUBLE AS lon, -47::DOUBLE + c_custkey * 7 % 1300 / 100.0::DOUBLE AS lat FROM customer)", *_NZTM) + _ON_NZTM)
def project_nztm(spark, sf):
    k = F.col("c_custkey")
    placed = fx.read(spark, sf, "customer").select(k.alias("id"), (166.5 + k % 1200 / 100.0).alias("longitude"), (-47.0 + k * 7 % 1300 / 100.0).alias("latitude"))
    return spatial.project(placed).select("id", _r("easting", 3), _r("northing", 3))


@query(_with(fx.SITES_SQL, "ext AS (SELECT min(easting) AS x0, max(easting) AS x9, min(northing) AS y0, max(northing) - 20000 AS y9 FROM site)",
             "g0 AS (SELECT *, CAST(round_even((x9 - x0) / 20000, 0) AS BIGINT) AS nx, CAST(round_even((y9 - y0) / 20000, 0) AS BIGINT) + 1 AS ny, (x9 - x0) / 20000 % 1 < 0.5 AS hx, (y9 - x0) / 20000 % 1 < 0.5 AS hy FROM ext)",
             "g1 AS (SELECT nx, ny, CASE WHEN hx THEN x0 + 10000 ELSE x0 END AS xa, CASE WHEN hx THEN x0 + 10000 + (nx - 1) * 20000 ELSE x0 + nx * 20000 END AS xb, CASE WHEN hy THEN y9 - 10000 - (ny - 2) * 20000 ELSE y9 + 10000 - (ny - 1) * 20000 END AS ya, CASE WHEN hy THEN y9 - 10000 ELSE y9 + 10000 END AS yb FROM g0)",
             "ce AS (SELECT i, j, xa + (xb - xa) * i / greatest(nx - 1, 1) AS x, ya + (yb - ya) * j / greatest(ny - 1, 1) AS y FROM g1, unnest(range(nx)) a(i), unnest(range(ny)) b(j))",
             "nn AS (SELECT site_id, row_number() OVER (PARTITION BY i, j ORDER BY sqrt(power(easting - x, 2) + power(northing - y, 2)), site_id) AS k, sqrt(power(easting - x, 2) + power(northing - y, 2)) AS d FROM ce, site)")
       + "SELECT DISTINCT site_id FROM nn WHERE k = 1 AND d <= sqrt(2 * 20000.0 * 20000.0) / 2")
def thin_sites(spark, sf):
    return spatial.thinned(fx.sites(spark, sf), 20_000.0).select("site_id")


_NEAR = "near AS (SELECT point_id, site_id, d FROM (SELECT point_id, site_id, d, rank() OVER (PARTITION BY point_id ORDER BY d) AS k FROM (SELECT point_id, site_id, sqrt(power(p.easting - s.easting, 2) + power(p.northing - s.northing, 2)) AS d FROM pt p, site s) WHERE d <= 10000) WHERE k <= {most})"


@query(_with(fx.POINTS_SQL, fx.SITES_SQL, _NEAR.format(most=500)) + f"SELECT point_id, site_id, {_s('d', 'distance', 3)} FROM near")
def mvn_neighbours(spark, sf):
    pairs = spatial.neighbours(fx.points(spark, sf).select("point_id", "easting", "northing"), fx.sites(spark, sf).select("site_id", "easting", "northing"))
    return pairs.select("point_id", F.col("s_site_id").alias("site_id"), _r("distance", 3))


@query(_with(fx.POINTS_SQL, fx.SITES_SQL, "n AS (SELECT point_id, site_id, sqrt(power(p.easting - s.easting, 2) + power(p.northing - s.northing, 2)) AS d FROM pt p, site s)", "k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, site_id) AS k FROM n WHERE d <= 15000)")
       + f"SELECT point_id, site_id, {_s('d', 'distance', 3)} FROM k WHERE k = 1")
def nearest_site(spark, sf):
    near = spatial.nearest(fx.points(spark, sf).select("point_id", "easting", "northing"), fx.sites(spark, sf), 15_000.0)
    return near.select("point_id", F.col("s_site_id").alias("site_id"), _r("distance", 3))


def _prior(spark, rows: DataFrame) -> DataFrame:
    return models.assign(rows, models.table(spark, "geology", "posterior_paper"), "gid", "geology")


@query(_with(fx.POINTS_SQL, fx.SITES_SQL, _table_sql("mo", models.GEOLOGY_POSTERIOR), _NEAR.format(most=1), "one AS (SELECT point_id, min(site_id) AS site_id, any_value(d) AS d FROM near GROUP BY point_id)",
             "x AS (SELECT pt.point_id, g.m, g.s, sm.m AS im, sm.s AS ism, site.vs30 AS obs, sqrt(sm.s * sm.s / (sm.s * sm.s + uncertainty * uncertainty)) AS om, exp(-greatest(0.1::DOUBLE, d) / 1407) AS rho, exp(-0.1::DOUBLE / 1407) AS r0 FROM pt LEFT JOIN mo g ON g.id = pt.gid LEFT JOIN one USING (point_id) LEFT JOIN site USING (site_id) LEFT JOIN mo sm ON sm.id = site.gid)",
             "y AS (SELECT *, rho * s * ism * om * exp(-1.5::DOUBLE * abs(ln(im) - ln(m))) AS c1, r0 * ism * ism AS c11 FROM x)")
       + f"SELECT point_id, {_s('exp(ln(m) + coalesce(c1 * om * ln(obs / im) / c11, 0))', 'vs30')}, {_s('sqrt(r0 * s * s - coalesce(c1 * c1 / c11, 0))', 'stdv')} FROM y")
def mvn_single(spark, sf):
    out = kriging.correct_single(_prior(spark, fx.points(spark, sf)), _prior(spark, fx.sites(spark, sf)), "geology")
    return out.select("point_id", _r("vs30"), _r("stdv"))


def _in_turn_sql(name: str, points: str, sites: str, model: str, most: int = 500) -> list[str]:
    """name (id, v, s): points (id, x, y, v, s) corrected by sites (id, x, y, obs, unc, v, s), one site after the other. Matrices are flat lists; step j takes site j's part off."""
    node = lambda x, y, w, s, log, r: f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE, 'w': {w}::DOUBLE, 's': {s}::DOUBLE, 'l': {log}::DOUBLE, 'r': {r}::DOUBLE}}"
    omega, a, b = "sqrt(q.s * q.s / (q.s * q.s + q.unc * q.unc))", "nodes[i // k + 1]", "nodes[i % k + 1]"
    shared = f"exp(-greatest(0.1::DOUBLE, sqrt(power({a}.x - {b}.x, 2) + power({a}.y - {b}.y, 2))) / {kriging.LENGTHS[model]}) * {a}.s * {b}.s * CASE WHEN i // k = i % k THEN 1 ELSE {a}.w * {b}.w END * exp(-1.5::DOUBLE * abs({a}.l - {b}.l))"
    return [
        f"{name}1 AS (SELECT p.id, q.id AS site, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) AS d, {node('q.x', 'q.y', omega, 'q.s', 'ln(q.v)', f'{omega} * ln(q.obs / q.v)')} AS node FROM {points} p, {sites} q WHERE p.v IS NOT NULL AND q.v IS NOT NULL AND q.s IS NOT NULL AND sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) <= 10000)",
        f"{name}2 AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY d) AS k FROM {name}1)",
        f"{name}3 AS (SELECT id, list(node ORDER BY d, site) AS others FROM {name}2 WHERE k <= {most} GROUP BY id)",
        f"{name}4 AS (SELECT id, list_concat([{node('x', 'y', '1', 's', 'ln(v)', '0')}], coalesce(others, [])) AS nodes FROM {points} LEFT JOIN {name}3 USING (id) WHERE v IS NOT NULL)",
        f"{name}5 AS (SELECT id, len(nodes) AS k, nodes FROM {name}4)",
        f"{name}6 AS (SELECT id, k, nodes[1].l AS l, list_transform(nodes, lambda n: n.r) AS r, list_transform(range(k * k), lambda i: {shared}) AS c FROM {name}5)",
        f"""{name}7 AS (SELECT id, CAST(1 AS BIGINT) AS j, k, l, r, c, list_transform(r, lambda x: 0::DOUBLE) AS m FROM {name}6 UNION ALL
          SELECT id, j + 1, k, l, r, list_transform(range(k * k), lambda i: c[i + 1] - c[i // k * k + j + 1] * c[j * k + i % k + 1] / c[j * k + j + 1]), list_transform(range(k), lambda t: m[t + 1] + c[j * k + t + 1] / c[j * k + j + 1] * (r[j + 1] - m[j + 1])) FROM {name}7 WHERE j < k)""",
        f"{name} AS (SELECT id, exp(l + m[1]) AS v, sqrt(c[1]) AS s FROM {name}7 WHERE j = k)",
    ]


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _mvn_sql(most: int) -> str:
    return _recursive(fx.POINTS_SQL, fx.SITES_SQL, _table_sql("mo", models.GEOLOGY_POSTERIOR),
                      "qp AS (SELECT point_id AS id, easting AS x, northing AS y, m AS v, s FROM pt LEFT JOIN mo ON mo.id = pt.gid)", "qs AS (SELECT site_id AS id, easting AS x, northing AS y, vs30 AS obs, uncertainty AS unc, m AS v, s FROM site LEFT JOIN mo ON mo.id = site.gid)",
                      *_in_turn_sql("t", "qp", "qs", "geology", most)) + f"SELECT qp.id AS point_id, {_s('t.v', 'vs30', 4)}, {_s('t.s', 'stdv', 4)} FROM qp LEFT JOIN t ON t.id = qp.id"


def _mvn(spark, sf, correct, **how) -> DataFrame:
    out = correct(_prior(spark, fx.points(spark, sf)), _prior(spark, fx.sites(spark, sf)), "geology", **how)
    return out.select("point_id", _r("geology_mvn_vs30", 4, "vs30"), _r("geology_mvn_stdv", 4, "stdv"))


@query(_mvn_sql(500))
def mvn_full(spark, sf):
    """The correction by all sites in reach, as one system a point; in the SQL, one site after the other."""
    return _mvn(spark, sf, kriging.correct)


@query(_mvn_sql(12))
def mvn_in_turn(spark, sf):
    """The same by at most a dozen sites, in native columns."""
    return _mvn(spark, sf, kriging.correct_in_turn)


@query(_mvn_sql(3))
def mvn_in_turn_bounded(spark, sf):
    """More sites in reach than are taken."""
    return _mvn(spark, sf, kriging.correct_in_turn, most=3)


@query(_with(fx.SITES_SQL, "u AS (SELECT NULL AS station, NULL::INTEGER AS q, easting, northing, vs30, 0.2::DOUBLE AS uncertainty FROM site WHERE site_id % 2 = 0 UNION ALL SELECT 'S' || site_id, CAST(1 + site_id % 3 AS INTEGER), easting, northing, vs30, CASE site_id % 3 WHEN 2 THEN 0.5::DOUBLE ELSE (1 + site_id % 3) / 10.0::DOUBLE END FROM site WHERE site_id % 2 = 1)")
       + "SELECT station, CAST(q AS DOUBLE) AS q, easting, northing, vs30, uncertainty FROM u WHERE q IS NULL OR q <> 3 OR length(station) = 3")
def site_union(spark, sf):
    rows = fx.sites(spark, sf)
    plain = rows.where("site_id % 2 = 0").select("easting", "northing", "vs30", F.lit(0.2).alias("uncertainty"))
    graded = rows.where("site_id % 2 = 1").select(F.concat(F.lit("S"), "site_id").alias("station"), (1 + F.col("site_id") % 3).cast("int").alias("q"), "easting", "northing", "vs30")
    graded = site_sources.reliable(graded.withColumn("uncertainty", site_sources.uncertainty(F.col("q"))))
    return site_sources.union(graded, plain).drop("site_id").withColumn("q", F.col("q").cast("double"))


# --- whole estimates -------------------------------------------------------------------------------------------------


def _layers(spark, sf) -> pipeline.Layers:
    slope = fx.raster(spark, sf).withColumn("value", F.col("value") / 40)
    edges = fx.polygons(spark, sf).withColumn("gid", (F.col("gid") % 16).cast("int"))
    coast = raster.coast_distance(fx.land(spark, sf), _G).withColumnRenamed("distance", "value")
    return pipeline.Layers(edges, fx.raster(spark, sf), _G, slope, _G, coast, _G)


def _estimate_columns(out: DataFrame, *keys: str) -> DataFrame:
    names = [f"{m}{x}{c}" for m in ("geology_", "terrain_", "") for x in ("", "mvn_") for c in ("vs30", "stdv")]
    return out.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("gid", "tid")], *[_r(n, 4) for n in names])


@query()
def points_pipeline(spark, sf):
    points = fx.points(spark, sf).select("point_id", "easting", "northing")
    sites = fx.sites(spark, sf).drop("gid", "tid")
    return _estimate_columns(pipeline.estimate(points, sites, _layers(spark, sf)), "point_id")


@query()
def grid_pipeline(spark, sf):
    sites = fx.sites(spark, sf).drop("gid", "tid")
    return _estimate_columns(pipeline.estimate_grid(_T, sites, _layers(spark, sf), pipeline.Settings(geology="posterior", terrain="posterior")), "row", "col")


@query()
def sounding_pipeline(spark, sf):
    """From raw soundings to Vs30 under all correlations: the flagship."""
    cut = pipeline.cpt_profiles(fx.soundings(spark, sf, 1.0, 0.01), ALL_CPT)
    return pipeline.profile_vs30(cut, KEYS, ["boore_2004"], shallow_is_null=True).select(*KEYS, "z", _r("vsz"), _r("vs30"))


ORACLE_SQL["sounding_pipeline"] = _with(*_cpt_profiles_sql(ALL_CPT), *TRUNCATED, *_vs30_sql(["boore_2004"])) + f"SELECT cpt_id, vs_correlation, z, {_s('vsz', 'vsz')}, {_s('vs30', 'vs30')} FROM h"

# --- whole estimates without the correction --------------------------------------------------------------------------

_LAYERS_SQL = [
    fx.POLYGONS_SQL, fx.RASTER_SQL, fx.LAND_SQL,
    "sea AS (SELECT x, y FROM land WHERE value = 0)",
    "far AS (SELECT l.row, l.col, least(20000, min(sqrt(power(l.x - s.x, 2) + power(l.y - s.y, 2)))) AS coast FROM land l, sea s WHERE l.value = 1 GROUP BY l.row, l.col)",
]


def _placed_sql(source: str, name: str, geology: str, terrain: str) -> list[str]:
    """source (id, x, y, ..) with the categories, slope and coast distance of the layers, and the values of both models."""
    c, r = f"floor((x - {_G.x0}) / {_G.dx})", f"floor((y - {_G.y0}) / ({_G.dy}))"
    slope = "log10(CASE WHEN slope IS NULL OR slope = 0 OR slope = -9999 THEN 1e-9 ELSE slope END)"
    return [
        f"{name}1 AS (SELECT q.id, e.gid % 16 AS gid FROM {source} q, edge e GROUP BY q.id, q.x, q.y, e.gid, e.feature_ord HAVING {_INSIDE})",
        f"{name}2 AS (SELECT id, min(gid) AS gid FROM {name}1 GROUP BY id)",
        f"{name}3 AS (SELECT q.*, p.gid, CAST(ras.value AS INTEGER) AS tid, ras.value / 40 AS slope, coast FROM {source} q LEFT JOIN {name}2 p USING (id) LEFT JOIN ras ON ras.col = {c} AND ras.row = {r} LEFT JOIN far ON far.col = {c} AND far.row = {r})",
        f"{name}4 AS (SELECT b.*, g.m AS gm, g.s AS gs, t.m AS terrain_vs30, t.s AS terrain_stdv, {slope} AS lg, hy.* EXCLUDE (id) FROM {name}3 b LEFT JOIN {geology} g ON g.id = b.gid LEFT JOIN {terrain} t ON t.id = b.tid LEFT JOIN hy ON hy.id = b.gid)",
        f"""{name}5 AS (SELECT *, CASE WHEN gid IN (4, 10) THEN CASE WHEN coast IS NULL THEN NULL WHEN gid = 4 THEN greatest(240, least(500, 240 + 260::DOUBLE * (coast - 8000) / 12000)) ELSE greatest(197, least(500, 197 + 303::DOUBLE * (coast - 8000) / 12000)) END
          WHEN f IS NULL THEN gm ELSE power(10::DOUBLE, log10(v0) + (log10(v1) - log10(v0)) * greatest(0, least(1, (lg - lo) / (hi - lo)))) END AS geology_vs30, gs * coalesce(f, 1) AS geology_stdv FROM {name}4)""",
        f"{name} AS (SELECT *, (ln(geology_vs30) + ln(terrain_vs30)) / 2 AS mean FROM {name}5)",
    ]


def _posterior_sql(prior: str, key: str, name: str) -> str:
    sums = f"(SELECT {key} AS id, sum(ln(vs30)) AS l, sum(uncertainty * uncertainty) AS u, count(*) AS n FROM placed WHERE {key} IS NOT NULL GROUP BY 1)"
    return f"{name} AS (SELECT p.id, CASE WHEN n IS NULL THEN m ELSE exp((3 * ln(m) + l) / (3 + n)) END AS m, sqrt((3 * power(greatest(s, 0.5::DOUBLE), 2) + coalesce(u, 0)) / (3 + coalesce(n, 0))) AS s FROM {prior} p LEFT JOIN {sums} a ON a.id = p.id)"


_MODELLED = ", ".join([
    "CAST(gid AS DOUBLE) AS gid", "CAST(tid AS DOUBLE) AS tid", *[_s(f"{m}_{c}", f"{m}_{c}", 4) for m in ("geology", "terrain") for c in ("vs30", "stdv")], _s("exp(mean)", "vs30", 4),
    _s("sqrt(0.5::DOUBLE * (power(ln(geology_vs30) - mean, 2) + geology_stdv * geology_stdv) + 0.5::DOUBLE * (power(ln(terrain_vs30) - mean, 2) + terrain_stdv * terrain_stdv))", "stdv", 4),
])


def _modelled(out: DataFrame, *keys: str) -> DataFrame:
    names = [f"{m}{c}" for m in ("geology_", "terrain_", "") for c in ("vs30", "stdv")]
    return pipeline.combined(out).select(*keys, F.col("gid").cast("double").alias("gid"), F.col("tid").cast("double").alias("tid"), *[_r(n, 4) for n in names])


_PLACES = "place AS (SELECT point_id AS id, easting AS x, northing AS y FROM pt)"


@query(_with(fx.POINTS_SQL, _PLACES, *_LAYERS_SQL, _HYBRID, _table_sql("mo", models.GEOLOGY_POSTERIOR), _table_sql("te", models.TERRAIN_POSTERIOR), *_placed_sql("place", "r", "mo", "te")) + f"SELECT id AS point_id, {_MODELLED} FROM r")
def points_models(spark, sf):
    """Categories, both models with slope and coast, and the two combined, at points."""
    settings = pipeline.Settings()
    tables = {m: models.table(spark, m, "posterior_paper") for m in ("geology", "terrain")}
    return _modelled(pipeline.modelled(fx.points(spark, sf).select("point_id", "easting", "northing"), _layers(spark, sf), tables, settings), "point_id")


@query(_with(fx.SITES_SQL, "sp AS (SELECT site_id AS id, easting AS x, northing AS y, vs30, uncertainty FROM site)", _PIXELS, f"pix AS (SELECT row * {_T.nx} + col AS id, * FROM px)", *_LAYERS_SQL, _HYBRID,
             _table_sql("gp", models.GEOLOGY_PRIOR), _table_sql("tp", models.TERRAIN_PRIOR), *_placed_sql("sp", "placed", "gp", "tp"), _posterior_sql("gp", "gid", "mo"), _posterior_sql("tp", "tid", "te"), *_placed_sql("pix", "r", "mo", "te"))
       + f"SELECT row, col, {_MODELLED} FROM r")
def grid_models(spark, sf):
    """The same over a grid, both models updated by the sites."""
    settings, layers = pipeline.Settings(geology="posterior", terrain="posterior"), _layers(spark, sf)
    tables = pipeline.measured(fx.sites(spark, sf).drop("gid", "tid"), layers, settings)[1]
    return _modelled(pipeline.modelled(raster.pixels(spark, _T), layers, tables, settings), "row", "col")


# --- whole estimates with the correction, one site after the other in the SQL ------------------------------------------

_SITE_PLACES = "sp AS (SELECT site_id AS id, easting AS x, northing AS y, vs30, uncertainty FROM site)"


def _corrected_sql(points: str, sites: str) -> list[str]:
    """fin: points with the values of both models as they are (g, t), corrected (gc, tc), and combined."""
    both = [(m, m[0]) for m in ("geology", "terrain")]
    inputs = [f"{k}_{what} AS (SELECT id, x, y, {more}{m}_vs30 AS v, {m}_stdv AS s FROM {table})" for m, k in both for what, table, more in (("p", points, ""), ("q", sites, "vs30 AS obs, uncertainty AS unc, "))]
    turns = [c for m, k in both for c in _in_turn_sql(f"{k}c", f"{k}_p", f"{k}_q", m)]
    return [*inputs, *turns, f"fin AS (SELECT r.*, gc.v AS geology_mvn_vs30, gc.s AS geology_mvn_stdv, tc.v AS terrain_mvn_vs30, tc.s AS terrain_mvn_stdv, (ln(gc.v) + ln(tc.v)) / 2 AS mvn_mean FROM {points} r LEFT JOIN gc ON gc.id = r.id LEFT JOIN tc ON tc.id = r.id)"]


def _estimate_sql(*keys: str) -> str:
    spread = lambda x, mean: f"sqrt(0.5::DOUBLE * (power(ln(geology_{x}vs30) - {mean}, 2) + power(geology_{x}stdv, 2)) + 0.5::DOUBLE * (power(ln(terrain_{x}vs30) - {mean}, 2) + power(terrain_{x}stdv, 2)))"
    each = [_s(f"{m}_{x}{c}", f"{m}_{x}{c}", 4) for m in ("geology", "terrain") for x in ("", "mvn_") for c in ("vs30", "stdv")]
    both = [y for x, mean in (("", "mean"), ("mvn_", "mvn_mean")) for y in (_s(f"exp({mean})", f"{x}vs30", 4), _s(spread(x, mean), f"{x}stdv", 4))]
    return ", ".join([*keys, "CAST(gid AS DOUBLE) AS gid", "CAST(tid AS DOUBLE) AS tid", *each, *both])


ORACLE_SQL["points_pipeline"] = (
    _recursive(fx.POINTS_SQL, fx.SITES_SQL, _PLACES, _SITE_PLACES, *_LAYERS_SQL, _HYBRID, _table_sql("mo", models.GEOLOGY_POSTERIOR), _table_sql("te", models.TERRAIN_POSTERIOR), *_placed_sql("place", "r", "mo", "te"), *_placed_sql("sp", "known", "mo", "te"), *_corrected_sql("r", "known"))
    + f"SELECT {_estimate_sql('id AS point_id')} FROM fin"
)
ORACLE_SQL["grid_pipeline"] = (
    _recursive(fx.SITES_SQL, _SITE_PLACES, _PIXELS, f"pix AS (SELECT row * {_T.nx} + col AS id, * FROM px)", *_LAYERS_SQL, _HYBRID, _table_sql("gp", models.GEOLOGY_PRIOR), _table_sql("tp", models.TERRAIN_PRIOR), *_placed_sql("sp", "placed", "gp", "tp"),
               _posterior_sql("gp", "gid", "mo"), _posterior_sql("tp", "tid", "te"), *_placed_sql("pix", "r", "mo", "te"), *_placed_sql("sp", "known", "mo", "te"), *_corrected_sql("r", "known"))
    + f"SELECT {_estimate_sql('row', 'col')} FROM fin"
)


@query(_with(fx.POINTS_SQL, fx.SITES_SQL, _table_sql("mo", models.GEOLOGY_POSTERIOR), _NEAR.format(most=2),
             "n AS (SELECT point_id, row_number() OVER (PARTITION BY point_id ORDER BY d, site_id) AS k, d, easting, northing, vs30 AS obs, m AS im, s, sqrt(s * s / (s * s + uncertainty * uncertainty)) AS om FROM near JOIN site USING (site_id) JOIN mo ON mo.id = gid)",
             "x AS (SELECT pt.point_id, g.m, g.s, exp(-0.1::DOUBLE / 1407) AS r0, a.d AS d1, b.d AS d2, a.s AS s1, b.s AS s2, a.om AS o1, b.om AS o2, a.im AS m1, b.im AS m2, a.om * ln(a.obs / a.im) AS e1, b.om * ln(b.obs / b.im) AS e2, sqrt(power(a.easting - b.easting, 2) + power(a.northing - b.northing, 2)) AS d12 FROM pt LEFT JOIN mo g ON g.id = pt.gid LEFT JOIN n a ON a.point_id = pt.point_id AND a.k = 1 LEFT JOIN n b ON b.point_id = pt.point_id AND b.k = 2)",
             "y AS (SELECT *, r0 * s1 * s1 AS c11, r0 * s2 * s2 AS c22, " + ", ".join(f"exp(-greatest(0.1::DOUBLE, {d}) / 1407) * {a} * {b} * {w} * exp(-1.5::DOUBLE * abs(ln({u}) - ln({v}))) AS {n}" for d, a, b, w, u, v, n in (("d12", "s1", "s2", "o1 * o2", "m1", "m2", "c12"), ("d1", "s", "s1", "o1", "m1", "m", "t1"), ("d2", "s", "s2", "o2", "m2", "m", "t2"))) + " FROM x)",
             "z AS (SELECT *, c11 * c22 - c12 * c12 AS det FROM y)")
       + f"""SELECT point_id, {_s('exp(ln(m) + CASE WHEN d1 IS NULL THEN 0 WHEN d2 IS NULL THEN t1 * e1 / c11 ELSE (t1 * (c22 * e1 - c12 * e2) + t2 * (c11 * e2 - c12 * e1)) / det END)', 'vs30')},
         {_s('sqrt(r0 * s * s - CASE WHEN d1 IS NULL THEN 0 WHEN d2 IS NULL THEN t1 * t1 / c11 ELSE (t1 * t1 * c22 - 2 * t1 * t2 * c12 + t2 * t2 * c11) / det END)', 'stdv')} FROM z""")  # fmt: skip
def mvn_pair(spark, sf):
    """The correction by the two nearest sites, solved by hand in the SQL."""
    out = kriging.correct(_prior(spark, fx.points(spark, sf)), _prior(spark, fx.sites(spark, sf)), "geology", most=2)
    return out.select("point_id", _r("geology_mvn_vs30", name="vs30"), _r("geology_mvn_stdv", name="stdv"))


@query(_with(fx.POINTS_SQL, fx.SITES_SQL, _NEAR.format(most=2)) + f"SELECT point_id, site_id, {_s('d', 'distance', 3)} FROM near")
def neighbours_bounded(spark, sf):
    """More sites in reach than are wanted."""
    pairs = spatial.neighbours(fx.points(spark, sf).select("point_id", "easting", "northing"), fx.sites(spark, sf).select("site_id", "easting", "northing"), most=2)
    return pairs.select("point_id", F.col("s_site_id").alias("site_id"), _r("distance", 3))


@query(_with(fx.SITES_SQL, "p AS (SELECT a.site_id, b.site_id AS other, sqrt(power(a.easting - b.easting, 2) + power(a.northing - b.northing, 2)) AS d FROM site a, site b)")
       + f"SELECT site_id, other, {_s('d', 'distance', 3)}, {_s('exp(-greatest(0.1::DOUBLE, d) / 1407)', 'geology', 9)}, {_s('exp(-greatest(0.1::DOUBLE, d) / 993)', 'terrain', 9)} FROM p WHERE d <= 20000")
def site_correlations(spark, sf):
    """Distances between sites and both models' correlation over them."""
    own = fx.sites(spark, sf).select("site_id", "easting", "northing")
    pairs = spatial.within(own, own, 20_000.0)
    return pairs.select("site_id", F.col("s_site_id").alias("other"), _r("distance", 3), *[_r(kriging.correlation("distance", m), 9, m) for m in kriging.LENGTHS])


# --- cases that the tables above do not reach ------------------------------------------------------------------------

_SILENT = "silent AS (SELECT * REPLACE (CASE WHEN pos % 5 = 2 THEN 0 ELSE n END AS n) FROM bh)"


def _silent(spark, sf) -> DataFrame:
    return fx.boreholes(spark, sf).withColumn("n", F.when(F.col("pos") % 5 == 2, 0.0).otherwise(F.col("n")))


def _silent_sql(name: str) -> list[str]:
    head, blows, first, *rest = _spt_sql(name)
    renumbered = first.replace("SELECT *,", "SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY spt_id ORDER BY pos) AS INTEGER) AS pos),", 1)
    return [head, _SILENT, blows.replace("FROM bh", "FROM silent"), renumbered, *rest]


@query(_with(*_silent_sql("brandenberg_2010")) + f"SELECT spt_id, pos, {_s('depth', 'depth')}, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')} FROM sp")
def spt_without_blows(spark, sf):
    """Rows without blows go and the others are renumbered."""
    return spt.profiles(_silent(spark, sf), ["brandenberg_2010"]).select("spt_id", "pos", _r("depth"), _r("vs", 4), _r("vs_sd"))


@query(_with(*_silent_sql("kwak_2015"), "p AS (SELECT spt_id AS cpt_id, 'kwak_2015' AS vs_correlation, pos, depth, vs, vs_sd FROM sp)", *TRUNCATED, *_vs30_sql(["boore_2004"])) + f"SELECT cpt_id AS spt_id, z, {_s('vsz', 'vsz')}, {_s('vs30', 'vs30')}, {_s('vs30_sd', 'vs30_sd')} FROM h")
def borehole_pipeline(spark, sf):
    """From blow counts to Vs30."""
    cut = pipeline.spt_profiles(_silent(spark, sf), ["kwak_2015"])
    return pipeline.profile_vs30(cut, ("spt_id", "vs_correlation"), ["boore_2004"], shallow_is_null=True).select("spt_id", "z", _r("vsz"), _r("vs30"), _r("vs30_sd"))


@query(_with(fx.BOREHOLES_SQL) + "SELECT spt_id, min_by(depth, pos) AS z_min, max_by(depth, pos) AS z_max, max_by(depth, pos) - min_by(depth, pos) AS z_spread FROM bh GROUP BY spt_id")
def spt_info(spark, sf):
    return spt.info(fx.boreholes(spark, sf))


@query(_with(*_short_sql(), "d AS (SELECT *, CASE WHEN moved THEN z ELSE depth END AS dd, NOT (depth <= z OR moved) AS gone FROM t3)")
       + f"SELECT cpt_id, vs_correlation, {_s('min(dd)', 'z_min')}, {_s('max(dd)', 'z_max')}, {_s('max(dd) - min(dd)', 'z_spread')}, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed, CAST(coalesce(sum(pos - 1) FILTER (gone), 0) AS BIGINT) AS sum_removed FROM d GROUP BY ALL")
def profile_info(spark, sf):
    out = profile.info(cpt.profiles(cpt.valid(fx.soundings(spark, sf, 1.0, 0.01, True)), NATIVE), KEYS)
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*KEYS, *[_r(c) for c in ("z_min", "z_max", "z_spread")], F.size("removed").alias("n_removed"), total.alias("sum_removed"))


@query(_with(SND) + f"SELECT cpt_id, pos, {_s('qc / 1000', 'qc', 9)}, {_s('fs / 1000', 'fs', 9)}, {_s('u / 1000', 'u', 9)} FROM snd")
def cpt_kpa(spark, sf):
    return cpt.kpa_to_mpa(fx.soundings(spark, sf)).select("cpt_id", "pos", _r("qc", 9), _r("fs", 9), _r("u", 9))


_ODD_SLOPE = "od AS (SELECT * REPLACE (CASE point_id % 5 WHEN 0 THEN -9999 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE slope END AS slope) FROM gv)"


@query(_with(*_GEO, _HYBRID, _ODD_SLOPE, "x AS (SELECT *, log10(CASE WHEN coalesce(slope, 0) = 0 OR slope = -9999 THEN 1e-9 ELSE slope END) AS lg FROM od LEFT JOIN hy ON hy.id = od.gid)")
       + f"SELECT point_id, {_s('CASE WHEN f IS NULL THEN geology_vs30 ELSE power(10::DOUBLE, log10(v0) + (log10(v1) - log10(v0)) * greatest(0, least(1, (lg - lo) / (hi - lo)))) END', 'vs30')}, {_s('geology_stdv * coalesce(f, 1)', 'stdv')} FROM x")
def hybrid_slope_missing(spark, sf):
    """Slopes of 0, no data or null, and category 4 by its slope too."""
    k = F.col("point_id") % 5
    odd = _geology(spark, sf).withColumn("slope", F.when(k == 0, models.SLOPE_NO_DATA).when(k == 1, None).when(k == 2, 0.0).otherwise(F.col("slope")))
    return models.hybrid(odd, mod6=False).select("point_id", _r("geology_vs30", name="vs30"), _r("geology_stdv", name="stdv"))


@query(_with(*_BOTH, "b1 AS (SELECT *, power(sa * sa, -2) / (power(sa * sa, -2) + power(sb * sb, -2)) AS wa FROM b0)", "b2 AS (SELECT *, ln(a) * wa + ln(b) * (1 - wa) AS mean FROM b1)")
       + f"SELECT point_id, {_s('exp(mean)', 'vs30')}, {_s('sqrt(wa * (power(ln(a) - mean, 2) + sa * sa) + (1 - wa) * (power(ln(b) - mean, 2) + sb * sb))', 'stdv')} FROM b2")
def combine_by_precision(spark, sf):
    """Weights by variance to the power -2."""
    both = models.assign(_geology(spark, sf), models.table(spark, "terrain", "posterior_paper"), "tid", "terrain")
    mean, sd = models.combine(*[F.col(c) for c in ("geology_vs30", "geology_stdv", "terrain_vs30", "terrain_stdv")], True, 2.0)
    return both.select("point_id", _r(mean, name="vs30"), _r(sd, name="stdv"))


@query(_with(fx.RASTER_SQL, _PIXELS) + f"SELECT px.row, px.col, nullif(value, 3) AS value FROM px LEFT JOIN ras ON ras.col = floor((x - {_G.x0}) / {_G.dx}) AND ras.row = floor((y - {_G.y0}) / ({_G.dy}))")
def raster_no_data(spark, sf):
    return raster.resample(raster.no_data(fx.raster(spark, sf), 3.0), _G, _T)


_GROWN = 6_000


@query(_with(fx.polygons_sql(_GROWN), fx.POINTS_SQL, f"hit AS (SELECT point_id, e.gid FROM (SELECT point_id, easting AS x, northing AS y FROM pt) q, edge e GROUP BY ALL HAVING {_INSIDE})") + "SELECT pt.point_id, CAST(min(hit.gid) AS DOUBLE) AS gid FROM pt LEFT JOIN hit USING (point_id) GROUP BY ALL")
def point_in_overlapping(spark, sf):
    return spatial.in_polygons(fx.points(spark, sf).drop("gid"), fx.polygons(spark, sf, _GROWN), 10_000.0).select("point_id", F.col("gid").cast("double").alias("gid"))


@query(_with(fx.polygons_sql(_GROWN), _PIXELS, f"hit AS (SELECT row, col, gid FROM px, edge GROUP BY ALL HAVING {_INSIDE})") + "SELECT px.row, px.col, CAST(max(gid) AS DOUBLE) AS value FROM px LEFT JOIN hit USING (row, col) GROUP BY ALL")
def rasterise_overlapping(spark, sf):
    """The last feature wins."""
    return raster.rasterise(fx.polygons(spark, sf, _GROWN), _T, 10_000.0).withColumn("value", F.col("value").cast("double"))


@query(_with(fx.POLYGONS_SQL) + "SELECT gid, feature_ord, x1, y1, x2, y2 FROM edge")
def polygon_edges(spark, sf):
    """Edges of polygons given as text."""
    corner = lambda x, y: F.concat_ws(" ", F.col(x).cast("long").cast("string"), F.col(y).cast("long").cast("string"))
    sides = fx.polygons(spark, sf).withColumn("k", F.monotonically_increasing_id()).groupBy("gid", "feature_ord").agg(F.array_sort(F.collect_list(F.struct("k", corner("x1", "y1").alias("p")))).alias("s"))
    ring = F.array_join(F.concat(F.transform("s", lambda r: r["p"]), F.array(F.col("s")[0]["p"])), ", ")
    text = F.concat(F.lit("POLYGON (("), ring, F.lit("))"))
    return polygon_sources.edges(sides, polygon_sources.wkt_rings(text))


@query(_with(fx.SITES_SQL, fx.POINTS_SQL, "b AS (SELECT min(easting) AS x0, max(easting) AS x9, min(northing) AS y9, max(northing) AS y0 FROM site)", "w AS (SELECT min(easting) AS a, max(easting) AS b, min(northing) AS c, max(northing) AS d FROM pt)",
             "g AS (SELECT *, round_even((x9 - x0) / 2000, 0) AS nx, round_even((y0 - y9) / 2500, 0) AS ny FROM b, w)",
             "s AS (SELECT *, greatest(0, ceil((x0 - a) / 2000)) AS l, greatest(0, ceil((d - y0) / 2500)) AS u, greatest(0, ceil((b - x0) / 2000) - nx) AS r, greatest(0, ceil((y0 - c) / 2500) - ny) AS o FROM g)",
             "k AS (SELECT x0 - l * 2000 AS x0, y0 + u * 2500 AS y0, CAST(nx + l + r AS BIGINT) AS nx, CAST(ny + u + o AS BIGINT) AS ny FROM s)")
       + "SELECT CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, CAST(x0 + (j + 0.5) * 2000 AS DOUBLE) AS easting, CAST(y0 - (i + 0.5) * 2500 AS DOUBLE) AS northing FROM k, unnest(range(ny)) a(i), unnest(range(nx)) b(j)")
def grid_extent(spark, sf):
    """Numbers of rows and columns from the extent of the sites, grown by whole cells to cover that of the points."""
    extent = lambda rows: rows.agg(*[f(c) for c in ("easting", "northing") for f in (F.min, F.max)]).first()
    grid = raster.Grid.over(*extent(fx.sites(spark, sf)), 2000, 2500).covering(*extent(fx.points(spark, sf)))
    return raster.pixels(spark, grid).select("row", "col", "easting", "northing")


# --- text forms and back ---------------------------------------------------------------------------------------------


@query(_with(SND) + f"SELECT 'c' || cpt_id AS name, pos, {_s('depth', 'depth')}, {_s('qc', 'qc')}, {_s('fs', 'fs')}, {_s('u', 'u')}, 1.0::DOUBLE AS gwl, 0.8::DOUBLE AS nar FROM snd")
def cpt_json(spark, sf):
    named = fx.soundings(spark, sf).withColumn("name", F.concat(F.lit("c"), "cpt_id"))
    return sounding_sources.cpt_from_json(sounding_sources.cpt_to_json(named, ("cpt_id",))).select("name", "pos", _r("depth"), _r("qc"), _r("fs"), _r("u"), "gwl", "nar")


@query(_with(fx.BOREHOLES_SQL, N60) + f"SELECT 's' || spt_id AS name, pos, {_s('depth', 'depth')}, {_s('n', 'n')}, soil, hammer, diameter, energy_ratio, {_s('n60', 'n60', 2)} FROM n6")
def spt_json(spark, sf):
    named = spt.n60(fx.boreholes(spark, sf)).withColumn("name", F.concat(F.lit("s"), "spt_id"))
    return sounding_sources.spt_from_json(sounding_sources.spt_to_json(named, ("spt_id",))).select("name", "pos", _r("depth"), _r("n"), "soil", "hammer", "diameter", "energy_ratio", _r("n60", 2))


@query(_with(*NATIVE_SQL) + f"SELECT 'p' || cpt_id AS name, vs_correlation, CAST(row_number() OVER (PARTITION BY cpt_id, vs_correlation ORDER BY pos) AS INTEGER) AS pos, {_s('depth', 'depth', 4)}, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')} FROM t")
def profile_json(spark, sf):
    cut = profile.truncate(_profiles(spark, sf), KEYS)
    named = cut.withColumns({"name": F.concat(F.lit("p"), "cpt_id"), "vs30_correlation": F.lit(None).cast("string"), "layered": F.lit(False)})
    return sounding_sources.profile_from_json(sounding_sources.profile_to_json(named, ("cpt_id",))).select("name", "vs_correlation", "pos", _r("depth", 4), _r("vs", 4), _r("vs_sd"))


@query(_with(*NATIVE_SQL) + f'SELECT {_s("depth", "x", 4).replace(" AS x", "")} AS "Depth", {_s("vs", "x", 4).replace(" AS x", "")} AS "Vs", {_s("vs_sd", "x").replace(" AS x", "")} AS "Vs_SD" FROM t')
def profile_table(spark, sf):
    out = sounding_sources.profile_table(profile.truncate(_profiles(spark, sf), KEYS))
    return out.select(_r("Depth", 4), _r("Vs", 4), _r("Vs_SD"))


# --- the calls behind a form -------------------------------------------------------------------------------------------


def _lines_sql(table: str, key: str, measures: dict[str, str]) -> list[str]:
    """st: staggered lines of each measure over the rows of table by key, the first row left out where it is 0 and not the only one."""
    each = []
    for name, value in measures.items():
        kept = f"(SELECT * FROM (SELECT *, {value} AS value, row_number() OVER o AS rn, count(*) OVER (PARTITION BY {key}) AS cnt FROM {table} WINDOW o AS (PARTITION BY {key} ORDER BY pos)) WHERE NOT coalesce(rn = 1 AND value = 0 AND cnt > 1, false))"
        lines = f"(SELECT {key}, value, row_number() OVER o - 1 AS k, coalesce((depth + lag(depth) OVER o) / 2, 0) AS z_top, coalesce((depth + lead(depth) OVER o) / 2, depth) AS z_bot FROM {kept} WINDOW o AS (PARTITION BY {key} ORDER BY pos))"
        each += [f"SELECT {key}, '{name}' AS measure, CAST(2 * k + {end} AS INTEGER) AS point, {z} AS depth, value FROM {lines}" for end, z in ((0, "z_top"), (1, "z_bot"))]
    return ["st AS (" + " UNION ALL ".join(each) + ")"]


def _lines(out: DataFrame, key: str) -> DataFrame:
    return out.select(key, "measure", F.col("point").cast("int").alias("point"), _r("depth"), _r("value"))


_IN_MPA = ("m AS (SELECT *, max(CASE WHEN pos = 51 THEN u END) OVER p AS mu, CASE WHEN count(*) OVER p > 100 THEN max(CASE WHEN pos = 101 THEN fs END) OVER p ELSE max(CASE WHEN pos = 6 THEN fs END) OVER p END AS mf FROM x WINDOW p AS (PARTITION BY cpt_id))",
           "cr AS (SELECT cpt_id, pos, depth, qc, CASE WHEN mf > 1 THEN fs / 1000 ELSE fs END AS fs, CASE WHEN coalesce(mu < 10, true) THEN u WHEN mu / 1000 < 10 THEN u / 1000 ELSE u / 1000 / 1000 END AS u FROM m)")


def _mixed_units(spark, sf) -> DataFrame:
    rows = cpt.valid(fx.soundings(spark, sf))
    return rows.withColumns({"fs": F.when(F.col("cpt_id") % 2 == 0, F.col("fs") * 1000).otherwise(F.col("fs")), "u": F.when(F.col("cpt_id") % 3 == 0, 1e5 + F.col("u")).otherwise(F.col("u"))})


@query(_with(SND, VALID, _UNITS, *_IN_MPA) + f"SELECT cpt_id, pos, {_s('depth', 'depth')}, {_s('qc', 'qc')}, {_s('fs', 'fs')}, {_s('u', 'u')} FROM cr")
def api_create_cpt(spark, sf):
    return api.create_cpt(_mixed_units(spark, sf)).select("cpt_id", "pos", *[_r(c) for c in ("depth", "qc", "fs", "u")])


@query(_with(SND, VALID, _UNITS, *_IN_MPA, *_lines_sql("cr", "cpt_id", {c: c for c in ("qc", "fs", "u")})) + f"SELECT cpt_id, measure, point, {_s('depth', 'depth')}, {_s('value', 'value')} FROM st")
def api_cpt_midpoints(spark, sf):
    return _lines(api.cpt_midpoints(api.create_cpt(_mixed_units(spark, sf))), "cpt_id")


@query(_with(fx.BOREHOLES_SQL, _SILENT, N60.replace("FROM bh", "FROM silent")) + f"SELECT spt_id, pos, {_s('n', 'n')}, {_s('n60', 'n60', 2)}, soil, hammer FROM n6")
def api_create_spt(spark, sf):
    return api.create_spt(_silent(spark, sf)).select("spt_id", "pos", _r("n"), _r("n60", 2), "soil", "hammer")


@query(_with(fx.BOREHOLES_SQL, _SILENT, N60.replace("FROM bh", "FROM silent"), *_lines_sql("n6", "spt_id", {"n": "n", "n60": "n60"})) + f"SELECT spt_id, measure, point, {_s('depth', 'depth')}, {_s('value', 'value')} FROM st")
def api_spt_midpoints(spark, sf):
    return _lines(api.spt_midpoints(_silent(spark, sf)), "spt_id")


@query(_with(*NATIVE_SQL, _layers_sql(), "n AS (SELECT *, cpt_id || '_' || vs_correlation AS label, row_number() OVER (PARTITION BY cpt_id, vs_correlation ORDER BY pos) - 1 AS k FROM l)", "b AS (SELECT label, CAST(2 * k AS INTEGER) AS point, z_top AS depth, vs, vs_sd FROM n UNION ALL SELECT label, CAST(2 * k + 1 AS INTEGER), z_bot, vs, vs_sd FROM n)")
       + f"SELECT label, point, {_s('depth', 'depth')}, {_s('vs', 'vs', 4)}, {_s('vs * exp(-vs_sd)', 'vs_below', 4)}, {_s('vs * exp(vs_sd)', 'vs_above', 4)} FROM b")
def api_profile_midpoints(spark, sf):
    out = api.profile_midpoints(profile.truncate(_profiles(spark, sf), KEYS), "cpt_id")
    return out.select("label", F.col("point").cast("int").alias("point"), _r("depth"), *[_r(c, 4) for c in ("vs", "vs_below", "vs_above")])


@query(_with(*_short_sql(["mcgann_2015"])) + f"SELECT 'p' || cpt_id AS name, pos, z, {_s('depth', 'depth', 4)}, {_s('vs', 'vs', 4)}, {_s('vs_sd', 'vs_sd')} FROM t")
def api_create_profile(spark, sf):
    """Profiles as they are uploaded: by name, not yet cut."""
    rows = cpt.profiles(cpt.valid(fx.soundings(spark, sf, 1.0, 0.01, True)), ["mcgann_2015"]).withColumn("name", F.concat(F.lit("p"), "cpt_id"))
    return api.create_profile(rows.select("name", "pos", "depth", "vs", "vs_sd")).select("name", "pos", "z", _r("depth", 4), _r("vs", 4), _r("vs_sd"))


def _named(spark, sf) -> DataFrame:
    return _short(spark, sf).withColumn("name", F.col("cpt_id").cast("string"))


@query(_average_sql().replace("cpt_id % 5 AS grp", "0 AS grp").replace("SELECT grp, CAST(row_number", "SELECT CAST(row_number").replace(_s("vs_sd", "vs_sd"), f"{_s('vs * exp(-vs_sd)', 'vs_below', 4)}, {_s('vs * exp(vs_sd)', 'vs_above', 4)}"))
def api_average(spark, sf):
    """One mean curve of all profiles, with its band."""
    curve = api.average(_named(spark, sf).withColumn("vs30_correlation", F.lit(None).cast("string")), _weights(spark, sf), KEYS)
    return curve.select(F.col("point").cast("int").alias("point"), _r("depth"), *[_r(c, 4) for c in ("vs", "vs_below", "vs_above")])


@query(ORACLE_SQL["weighted_vs30"])
def api_vs30(spark, sf):
    return api.vs30(_named(spark, sf), _weights(spark, sf), ("cpt_id", "name", "vs_correlation"), ["boore_2004", "boore_2011"]).select(_r("vs30"), _r("vs30_sd"))


# --- errors as rows ----------------------------------------------------------------------------------------------------

#: Soundings of which some have a negative depth, no valid row, or 3 m only.
_FAULTY = [fx.soundings_sql(1.0, 0.01).replace("snd AS", "snd0 AS", 1), "snd1 AS (SELECT * REPLACE (CASE WHEN cpt_id % 10 IN (3, 4) AND pos = 2 THEN -depth ELSE depth END AS depth, CASE WHEN cpt_id % 10 IN (4, 7) THEN 0 ELSE qc END AS qc) FROM snd0 WHERE NOT (cpt_id % 10 = 5 AND pos > 60))"]
_USABLE = [*_FAULTY, "snd AS (SELECT * FROM snd1 WHERE cpt_id % 10 NOT IN (3, 4, 7))", *_cpt_profiles_sql(NATIVE)[1:], *TRUNCATED, *_vs30_sql(["boore_2004", "boore_2011"])]
_TOLD = "'{0}' AS condition, '{1}' AS message, CAST({2} AS INTEGER) AS code"


def _faulty(spark, sf) -> DataFrame:
    k, rows = F.col("cpt_id") % 10, fx.soundings(spark, sf, 1.0, 0.01)
    return rows.where(~((k == 5) & (F.col("pos") > 60))).withColumns({"depth": F.when(k.isin(3, 4) & (F.col("pos") == 2), -F.col("depth")).otherwise(F.col("depth")), "qc": F.when(k.isin(4, 7), 0.0).otherwise(F.col("qc"))})


def _condition(name: str) -> str:
    return _TOLD.format(name, *checks.CONDITIONS[name])


@query(_with(*_USABLE) + f"SELECT cpt_id, vs_correlation, vs30_correlation, z, {_s('vs30', 'vs30')}, {_s('vs30_sd', 'vs30_sd')} FROM h WHERE z = 30 OR sigma IS NOT NULL")
def checked_vs30(spark, sf):
    """Vs30 of the soundings that can be used."""
    good, _ = pipeline.checked_cpt_vs30(_faulty(spark, sf), NATIVE, ["boore_2004", "boore_2011"])
    return good.select(*KEYS, "vs30_correlation", "z", _r("vs30"), _r("vs30_sd"))


@query(_with(*_USABLE) + f"""SELECT DISTINCT cpt_id, NULL::VARCHAR AS vs_correlation, NULL::VARCHAR AS vs30_correlation, {_condition('NEGATIVE_DEPTH')} FROM snd1 WHERE cpt_id % 10 IN (3, 4) AND pos = 2
  UNION ALL SELECT DISTINCT cpt_id, NULL, NULL, {_condition('NO_VALID_ROWS')} FROM snd1 WHERE cpt_id % 10 IN (4, 7) UNION ALL SELECT cpt_id, vs_correlation, vs30_correlation, {_condition('TOO_SHALLOW')} FROM h WHERE z <> 30 AND sigma IS NULL""")
def checked_errors(spark, sf):
    """What can't be used, by sounding and correlation."""
    return pipeline.checked_cpt_vs30(_faulty(spark, sf), NATIVE, ["boore_2004", "boore_2011"])[1]


_ODD_HOLES = "odd AS (SELECT * REPLACE (CASE WHEN spt_id % 6 = 1 AND pos = 1 THEN -1 ELSE depth END AS depth, CASE WHEN spt_id % 6 IN (2, 3) THEN 'Steam' WHEN spt_id % 6 = 4 THEN NULL ELSE hammer END AS hammer, CASE WHEN spt_id % 6 = 3 AND pos = 2 THEN 'Jelly' ELSE soil END AS soil) FROM bh)"


@query(_with(fx.BOREHOLES_SQL, _ODD_HOLES) + f"""SELECT DISTINCT spt_id, {_condition('NEGATIVE_DEPTH')} FROM odd WHERE depth < 0 UNION ALL SELECT DISTINCT spt_id, {_condition('UNKNOWN_HAMMER')} FROM odd WHERE hammer = 'Steam'
  UNION ALL SELECT DISTINCT spt_id, {_condition('UNKNOWN_SOIL')} FROM odd WHERE soil = 'Jelly'""")
def spt_errors(spark, sf):
    k, pos, rows = F.col("spt_id") % 6, F.col("pos"), fx.boreholes(spark, sf)
    odd = rows.withColumns({"depth": F.when((k == 1) & (pos == 1), -1.0).otherwise(F.col("depth")), "hammer": F.when(k.isin(2, 3), "Steam").when(k == 4, None).otherwise(F.col("hammer")), "soil": F.when((k == 3) & (pos == 2), "Jelly").otherwise(F.col("soil"))})
    return checks.spt(odd)[1]


# --- rasters as files --------------------------------------------------------------------------------------------------


@query(_with(fx.RASTER_SQL) + "SELECT row, col, value, value / 8 AS eighth FROM ras WHERE row BETWEEN 20 AND 70 AND col BETWEEN 10 AND 95")
def raster_blocks(spark, sf):
    """Two bands written as GeoTIFF blocks, and a window of them read back. The files are in the folder that driver and executors share."""
    path = f"{shared_dir(spark).removeprefix('file://')}/blocks-{uuid.uuid4().hex}"
    tile_files.write_tiles(fx.raster(spark, sf).withColumn("eighth", F.col("value") / 8), _G, path, block=32)
    return tile_files.read_tiles(spark, path, ["value", "eighth"], 32, (20, 70), (10, 95))
