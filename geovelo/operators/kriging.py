"""Spatial correction of a velocity model near measured sites: a conditional Gaussian over at most 500 sites within 10 km."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col
from .spatial import neighbours

#: Correlation lengths in m by model; the shortest distance that counts.
LENGTHS, SHORTEST = {"geology": 1407.0, "terrain": 993.0}, 0.1
REACH, MOST, REDUCTION = 10_000.0, 500, 1.5
#: Sites up to which the site table (56 bytes a row) goes to every task; beyond it points and sites meet by cells.
BROADCAST_SITES = 100_000
#: Numbers in one batch of matrices, and in the matrix of all sites that points solved together share.
BATCH, SHARED = 2_000_000, 4_000_000
#: Priors at one place that are solved together.
PRIORS = 1_000
#: Sites at most that a point's correction takes in turn: the work grows with their number cubed and is interpreted.
FEW = 32
#: Side in m of the squares by which points are dealt to tasks and solved together, small enough for most of their sites to be the same; tasks a core: the work is in the solve, not in the rows, so tasks don't follow from bytes.
SQUARE, TASKS = REACH / 4, 8
#: Squares along one axis, as steps from a point's own, that hold all within reach.
AROUND = range(-4, 5)


def correlation(distance: Column | str, model: str) -> Column:
    return F.exp(-F.greatest(F.lit(SHORTEST), col(distance)) / LENGTHS[model])


def _rho(distance: np.ndarray, length: float) -> np.ndarray:
    return np.exp(-np.maximum(SHORTEST, distance) / length)


def conditioned(x: np.ndarray, y: np.ndarray, mean: np.ndarray, sd: np.ndarray, sites: np.ndarray, length: float, noisy: bool = True, reduction: float = REDUCTION, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(vs30, sigma) of points of one neighbourhood. sites: rows of easting, northing, vs30, uncertainty, model vs30, model sigma.

    Points at one place have one system, solved once for all priors there. Covariances between sites are computed once for all places that are solved
    together, and the sites that all of them use are eliminated once for all (a Schur complement, so the result is the same); each place then solves for its other sites.
    Places are solved in batches of equally large systems: a place with fewer sites is filled up with ones on the diagonal
    and zeros elsewhere, which changes nothing. Sites at one place without uncertainty make the system singular, an error.
    """
    if not len(sites) or not len(x):
        return mean, np.sqrt(sd**2 * np.exp(-SHORTEST / length))
    asked, of = np.unique(np.column_stack((x, y, mean, sd)), axis=0, return_inverse=True)
    new = np.r_[True, (asked[1:, :2] != asked[:-1, :2]).any(axis=1)]
    slot = np.arange(len(asked)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(slot % PRIORS == 0)
    own = np.diff(np.r_[first, len(asked)])
    pred, var = np.log(asked[:, 2]), asked[:, 3] ** 2 * np.exp(-SHORTEST / length)
    step = max(1, BATCH // len(sites))  # distances of all places to all sites are held at once
    for lo in range(0, len(first), step):
        _conditioned(asked, first[lo : lo + step], own[lo : lo + step], pred, var, sites, length, noisy, reduction, most)
    of = of.ravel()
    return np.exp(pred)[of], np.sqrt(var)[of]


def _conditioned(asked: np.ndarray, first: np.ndarray, own: np.ndarray, pred: np.ndarray, var: np.ndarray, sites: np.ndarray, length: float, noisy: bool, reduction: float, most: int) -> None:
    """Puts into pred (a logarithm) and var what sites tell at some places. asked: rows of easting, northing, vs30, sigma; a place's are the own ones from first on."""
    apart = np.hypot(asked[first, 0][:, None] - sites[:, 0], asked[first, 1][:, None] - sites[:, 1])
    near = apart <= REACH
    if len(sites) > most:
        near &= apart <= np.partition(apart, most - 1, axis=1)[:, most - 1 : most]
    used = np.flatnonzero(near.any(axis=0))
    if len(first) > 1 and len(used) ** 2 > SHARED:
        half = len(first) // 2
        for part in (slice(0, half), slice(half, None)):
            _conditioned(asked, first[part], own[part], pred, var, sites[used], length, noisy, reduction, most)
        return
    near, apart = near[:, used], apart[:, used]
    se, sn, obs, unc, model, ssd = sites[used].T
    omega = np.sqrt(ssd**2 / (ssd**2 + unc**2)) if noisy else np.ones(len(used))
    resid, ln, weight = omega * np.log(obs / model), np.log(model), ssd * omega
    shared = _rho(np.hypot(se[:, None] - se, sn[:, None] - sn), length) * np.exp(-reduction * np.abs(ln[:, None] - ln)) * weight[:, None] * weight
    np.fill_diagonal(shared, ssd**2 * np.exp(-SHORTEST / length))
    core, edge = _core(near)
    inverse = np.linalg.inv(shared[np.ix_(core, core)])
    by = inverse @ shared[np.ix_(core, edge)]
    told, resid = inverse @ resid[core], resid[edge] - resid[core] @ by
    shared = shared[np.ix_(edge, edge)] - shared[np.ix_(edge, core)] @ by
    near = near[:, edge]
    counts = near.sum(axis=1)
    order = np.argsort(-counts, kind="stable")
    order = order[(counts[order] > 0) | (len(core) > 0)]
    lo = 0
    while lo < len(order):
        k, most_own = int(counts[order[lo]]), int(own[order[lo:]].max())
        rows = order[lo : lo + max(1, BATCH // (k * k + (len(used) + k) * most_own))]
        lo += len(rows)
        at = np.argsort(~near[rows], axis=1, kind="stable")[:, :k]
        real = np.take_along_axis(near[rows], at, axis=1)
        c = shared[at[:, :, None], at[:, None, :]]
        if not real.all():
            c *= real[:, :, None] & real[:, None, :]
            c[:, np.arange(k), np.arange(k)] += ~real
        # a place with fewer priors than the others repeats its last one
        prior = first[rows][:, None] + np.minimum(np.arange(own[rows].max()), own[rows][:, None] - 1)
        sd, log = asked[prior, 3], np.log(asked[prior, 2])

        def covariances(of: np.ndarray) -> np.ndarray:
            """Of each place's priors with its sites at the positions of: (places, priors, sites)."""
            one = _rho(np.take_along_axis(apart[rows], of, axis=1), length) * weight[of]  # noqa: B023
            return one[:, None, :] * sd[:, :, None] * np.exp(-reduction * np.abs(ln[of][:, None, :] - log[:, :, None]))  # noqa: B023

        t = covariances(np.broadcast_to(core, (len(rows), len(core))))
        rest = (covariances(edge[at]) - np.take_along_axis(t @ by, at[:, None, :], axis=2)) * real[:, None, :]
        sol = np.linalg.solve(c, np.concatenate(((resid[at] * real)[:, :, None], rest.transpose(0, 2, 1)), axis=2))
        pred[prior] = log + t @ told + np.einsum("ikj,ij->ik", rest, sol[:, :, 0])
        var[prior] = sd**2 * np.exp(-SHORTEST / length) - np.einsum("ikj,ikj->ik", t @ inverse, t) - np.einsum("ikj,ijk->ik", rest, sol[:, :, 1:])


def _core(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(core, edge): positions of the sites that all places use, to be eliminated once for all of them, and of the others. near: (places, sites). No core where it costs more than it saves."""
    all_use = near.all(axis=0)
    n, used = int(all_use.sum()), near.sum(axis=1, dtype=float)
    m = len(all_use) - n
    if 2 * n * (n * n + n * m + m * m) + 2 / 3 * ((used - n) ** 3).sum() >= 2 / 3 * (used**3).sum():
        all_use[:] = False
    return np.flatnonzero(all_use), np.flatnonzero(~all_use)


def _solve(points: pd.DataFrame, sites: np.ndarray, cells: dict | None, prefix: str, length: float, most: int = MOST) -> pd.DataFrame:
    out_v, out_s = np.full(len(points), np.nan), np.full(len(points), np.nan)
    e, n, v, s = (points[c].to_numpy(float) for c in ("easting", "northing", f"{prefix}_vs30", f"{prefix}_stdv"))
    usable = np.flatnonzero(~np.isnan(v) & ~np.isnan(e) & ~np.isnan(n))
    if cells is None:
        out_v[usable], out_s[usable] = conditioned(e[usable], n[usable], v[usable], s[usable], sites, length, most=most)
    else:
        cx, cy = np.floor(e[usable] / SQUARE).astype(int), np.floor(n[usable] / SQUARE).astype(int)
        order = np.lexsort((cy, cx))
        cuts = np.flatnonzero((np.diff(cx[order]) != 0) | (np.diff(cy[order]) != 0)) + 1
        for part in np.split(order, cuts) if len(order) else []:
            a, b = cx[part[0]], cy[part[0]]
            near = [k for i in AROUND for j in AROUND for k in cells.get((a + i, b + j), ())]
            rows = usable[part]
            out_v[rows], out_s[rows] = conditioned(e[rows], n[rows], v[rows], s[rows], sites[near], length, most=most)
    # null, not NaN, for points without a model value
    return points.assign(**{f"{prefix}_mvn_vs30": pd.array(np.where(np.isnan(out_v), None, out_v), "Float64"), f"{prefix}_mvn_stdv": pd.array(np.where(np.isnan(out_s), None, out_s), "Float64")})


def _site_rows(sites: DataFrame, prefix: str) -> DataFrame:
    names = ("easting", "northing", "vs30", "uncertainty", f"{prefix}_vs30", f"{prefix}_stdv")
    return sites.where(" AND ".join(f"{c} IS NOT NULL" for c in names)).select(*[F.col(c).cast("double") for c in names])


def correct(points: DataFrame, sites: DataFrame, model: str, most: int = MOST) -> DataFrame:
    """points plus <model>_mvn_vs30 and <model>_mvn_stdv, each by its nearest sites within reach, most of them at most (ties at that distance stay). Points without a model value get null; points without a site in reach keep their velocity.

    Points are dealt by squares, so that points whose sites are mostly the same meet. The site table is counted: up to BROADCAST_SITES
    rows it goes to every task, else each square's points are brought together with the sites around it.
    """
    schema = T.StructType([*points.schema.fields, T.StructField(f"{model}_mvn_vs30", T.DoubleType()), T.StructField(f"{model}_mvn_stdv", T.DoubleType())])
    rows = _site_rows(sites, model)
    length, spark = LENGTHS[model], points.sparkSession
    tasks = TASKS * spark.sparkContext.defaultParallelism
    square = lambda c: F.floor(F.col(c) / SQUARE)
    some = rows.limit(BROADCAST_SITES + 1).toArrow()
    if some.num_rows <= BROADCAST_SITES:
        known = np.stack([c.to_numpy() for c in some.columns], axis=1).astype(float)
        shared = spark.sparkContext.broadcast(known)

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, cells = shared.value, {}
            for k, (e, n) in enumerate(np.floor(own[:, :2] / SQUARE).astype(int).tolist()):
                cells.setdefault((e, n), []).append(k)
            for batch in batches:
                yield _solve(batch, own, cells, model, length, most)

        dealt = points.repartition(tasks, square("easting"), square("northing"))
        return dealt.sortWithinPartitions(square("easting"), square("northing"), "easting", "northing").mapInPandas(solve, schema)
    dealt = points.withColumns({"_cx": square("easting"), "_cy": square("northing")})
    near = F.array(*[F.lit(k) for k in AROUND])
    spread = rows.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    spread = spread.select(*rows.columns, (square("easting") + F.col("_dx")).alias("_cx"), (square("northing") + F.col("_dy")).alias("_cy"))
    names, site_names = points.columns, rows.columns

    def meet(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return _solve(p[names], s[site_names].to_numpy(float), None, model, length, most)

    keys = ["_cx", "_cy"]
    return dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(spread.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(meet, schema)


def correct_single(points: DataFrame, sites: DataFrame, model: str) -> DataFrame:
    """(point_id, vs30, stdv): the same correction by the nearest site alone, in native columns."""
    named = sites.where(F.col(f"{model}_vs30").isNotNull())
    one = neighbours(points.select("point_id", "easting", "northing"), named, REACH, 1)
    site = one.groupBy("point_id").agg(F.min(F.struct("s_site_id", "distance", "s_vs30", "s_uncertainty", f"s_{model}_vs30", f"s_{model}_stdv")).alias("_s")).select("point_id", "_s.*")
    joined = points.join(site, "point_id", "left")
    prior, sd = F.col(f"{model}_vs30"), F.col(f"{model}_stdv")
    m, s, u = F.col(f"s_{model}_vs30"), F.col(f"s_{model}_stdv"), F.col("s_uncertainty")
    omega = F.sqrt(s * s / (s * s + u * u))
    least = correlation(F.lit(0.0), model)
    c1 = correlation("distance", model) * sd * s * omega * F.exp(-REDUCTION * F.abs(F.log(m) - F.log(prior)))
    c11 = least * s * s
    shift = F.coalesce(c1 * omega * F.log(F.col("s_vs30") / m) / c11, F.lit(0.0))
    variance = least * sd * sd - F.coalesce(c1 * c1 / c11, F.lit(0.0))
    return joined.select("point_id", F.exp(F.log(prior) + shift).alias("vs30"), F.sqrt(variance).alias("stdv"))


def _covariance(a: Column, b: Column, model: str) -> Column:
    """Of two different nodes (easting, northing, weight, stdv, log, ..)."""
    apart = F.hypot(a["easting"] - b["easting"], a["northing"] - b["northing"])
    return correlation(apart, model) * a["stdv"] * b["stdv"] * a["weight"] * b["weight"] * F.exp(-REDUCTION * F.abs(a["log"] - b["log"]))


def in_turn(sites: Column, model: str) -> Column:
    """What conditioning on one site after the other takes off the sites that come later, in native columns.

    sites: array of (easting, northing, weight, stdv, log, residual). An array of (pivot, news, rest), one a site: its variance and its residual given the
    sites before it, and its covariances with those after it. It is the same for all priors at a place.
    """
    least = correlation(F.lit(0.0), model)
    row = lambda a, i: F.transform(sites, lambda b, j: F.when(i == j, least * a["stdv"] * a["stdv"]).otherwise(_covariance(a, b, model)))
    told = F.struct(F.lit(0.0).alias("pivot"), F.lit(0.0).alias("news"), F.array(F.lit(0.0)).alias("rest"))
    start = F.struct(F.transform(sites, row).alias("c"), F.transform(sites, lambda a: a["residual"]).alias("r"), F.filter(F.array(told), lambda x: F.lit(False)).alias("told"))
    later = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))

    def given(state: Column, _: Column) -> Column:
        first = F.get(state["c"], F.lit(0))
        step = F.struct(F.get(first, F.lit(0)).alias("pivot"), F.get(state["r"], F.lit(0)).alias("news"), later(first).alias("rest"))

        def taken(s: Column) -> Column:
            c = F.transform(later(state["c"]), lambda own: F.zip_with(later(own), s["rest"], lambda x, t: x - F.get(own, F.lit(0)) * t / s["pivot"]))
            r = F.zip_with(later(state["r"]), s["rest"], lambda x, t: x - t * s["news"] / s["pivot"])
            return F.struct(c.alias("c"), r.alias("r"), F.concat(state["told"], F.array(s)).alias("told"))

        # a lambda's variable holds the step, so it is worked out once
        return F.get(F.transform(F.array(step), taken), F.lit(0))

    return F.aggregate(sites, start, given, lambda state: state["told"])


def conditioned_in_turn(node: Column, sites: Column, told: Column, model: str) -> Column:
    """(vs30, stdv) of a point, a node like its sites with weight 1, by what in_turn() tells of the sites."""
    start = F.struct(F.transform(sites, lambda a: _covariance(node, a, model)).alias("t"), node["log"].alias("mean"), (correlation(F.lit(0.0), model) * node["stdv"] * node["stdv"]).alias("var"))

    def given(state: Column, s: Column) -> Column:
        own = F.get(state["t"], F.lit(0))
        t = F.zip_with(F.slice(state["t"], 2, F.size(s["rest"])), s["rest"], lambda x, y: x - own * y / s["pivot"])
        return F.struct(t.alias("t"), (state["mean"] + own * s["news"] / s["pivot"]).alias("mean"), (state["var"] - own * own / s["pivot"]).alias("var"))

    return F.aggregate(told, start, given, lambda state: F.struct(F.exp(state["mean"]).alias("vs30"), F.sqrt(state["var"]).alias("stdv")))


def correct_in_turn(points: DataFrame, sites: DataFrame, model: str, most: int = 12) -> DataFrame:
    """correct() for few sites a point (FEW at most), as a lazy plan without Python: sites are looked up by cells and taken into account in turn, the nearest first.

    Sites are looked up once for each place and taken in turn once for each place; each different prior there costs a pass over what that tells. Ties at the
    distance of the last site stay. Points without a model value get null, points without a site in reach keep their velocity.
    """
    if most > FEW:
        raise ValueError(f"more than {FEW} sites in turn; use correct()")
    prior, sd, at = f"{model}_vs30", f"{model}_stdv", ["_e", "_n"]
    named = [F.col(c).cast("double").alias(n) for c, n in (("easting", "_e"), ("northing", "_n"), (prior, "_v"), (sd, "_sd"))]
    asked = points.where(" AND ".join(f"{c} IS NOT NULL" for c in ("easting", "northing", prior, sd))).select(*named).distinct()
    places = asked.select(*at).distinct().select(F.struct(*at).alias("point_id"), F.col("_e").alias("easting"), F.col("_n").alias("northing"))
    near = neighbours(places, _site_rows(sites, model), REACH, most, native=True)
    s, u, v = F.col(f"s_{sd}"), F.col("s_uncertainty"), F.col(f"s_{prior}")
    omega = F.sqrt(s * s / (s * s + u * u))
    node = lambda e, n, w, sd, log, r: F.struct(e.alias("easting"), n.alias("northing"), w.alias("weight"), sd.alias("stdv"), log.alias("log"), r.alias("residual"))
    site = node(F.col("s_easting"), F.col("s_northing"), omega, s, F.log(v), omega * F.log(F.col("s_vs30") / v))
    listed = near.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("distance", site.alias("site"))))["site"].alias("_s"))
    told = listed.select(F.col("point_id._e").alias("_e"), F.col("point_id._n").alias("_n"), "_s", in_turn(F.col("_s"), model).alias("_told"))
    own = node(F.col("_e"), F.col("_n"), F.lit(1.0), F.col("_sd"), F.log("_v"), F.lit(0.0))
    none = lambda c: F.coalesce(c, F.array().cast(told.schema[c].dataType))
    answers = asked.join(told, at, "left").select(*at, "_v", "_sd", conditioned_in_turn(own, none("_s"), none("_told"), model).alias("_t"))
    keys = [x.alias(c) for x, c in zip((F.col(c).cast("double") for c in ("easting", "northing", prior, sd)), [*at, "_v", "_sd"], strict=True)]
    joined = points.select("*", *keys).join(answers, [*at, "_v", "_sd"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in points.columns], F.col("_t.vs30").alias(f"{model}_mvn_vs30"), F.col("_t.stdv").alias(f"{model}_mvn_stdv"))
