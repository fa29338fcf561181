"""Operators against plain numpy and Python written from the formulas, and properties that must hold."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geovelo.functions import projection
from geovelo.operators import cluster, cpt, ensemble, kriging, models, profile, raster, spatial, spt
from geovelo.operators.raster import Grid


def _mvn(x, y, v, s, sites, length):
    """One point at a time, with an inverse."""
    pred, var = math.log(v), s * s * math.exp(-0.1 / length)
    d = np.hypot(sites[:, 0] - x, sites[:, 1] - y)
    keep = (d <= 10_000) & (d <= np.sort(d)[min(500, len(d)) - 1])
    if not keep.any():
        return v, math.sqrt(var)
    e, n, obs, unc, m, ms = sites[keep].T
    om = np.sqrt(ms**2 / (ms**2 + unc**2))
    xs, ys, sd, ln, w = np.r_[x, e], np.r_[y, n], np.r_[s, ms], np.r_[pred, np.log(m)], np.r_[1, om]
    dist = np.hypot(xs[:, None] - xs, ys[:, None] - ys)
    omega = np.outer(w, w)
    np.fill_diagonal(omega, 1)
    c = np.exp(-np.maximum(0.1, dist) / length) * np.outer(sd, sd) * omega * np.exp(-1.5 * np.abs(ln[:, None] - ln))
    inv = np.linalg.inv(c[1:, 1:])
    return math.exp(pred + c[0, 1:] @ inv @ (om * np.log(obs / m))), math.sqrt(c[0, 0] - c[0, 1:] @ inv @ c[1:, 0])


def _random_sites(rng, n, side=30_000):
    return np.column_stack((rng.uniform(0, side, n), rng.uniform(0, side, n), rng.uniform(150, 800, n), rng.choice([0.1, 0.2, 0.5], n), rng.uniform(150, 700, n), rng.uniform(0.2, 0.6, n)))


@pytest.mark.parametrize("n_sites", [0, 1, 40, 700])
def test_conditioned_matches_inverse(n_sites):
    rng = np.random.default_rng(n_sites)
    sites = _random_sites(rng, n_sites, 9_000 if n_sites == 700 else 30_000)
    x, y, v, s = rng.uniform(0, 30_000, 30), rng.uniform(0, 30_000, 30), rng.uniform(150, 700, 30), rng.uniform(0.2, 0.6, 30)
    got = np.array(kriging.conditioned(x, y, v, s, sites, 1407.0)).T
    want = [_mvn(*p, sites, 1407.0) if n_sites else (p[2], p[3] * math.exp(-0.05 / 1407)) for p in zip(x, y, v, s)]
    np.testing.assert_allclose(got, want, rtol=1e-7)


def test_correct_by_broadcast_and_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sites = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(_random_sites(rng, 30))], "site_id long, easting double, northing double, vs30 double, uncertainty double, terrain_vs30 double, terrain_stdv double")
    rows = [(i, float(a), float(b), 300.0, 0.4) for i, (a, b) in enumerate(rng.uniform(0, 60_000, (200, 2)))] + [(900, 0.0, 0.0, None, None)]
    points = spark.createDataFrame(rows, "point_id long, easting double, northing double, terrain_vs30 double, terrain_stdv double")
    one = {r.point_id: r for r in kriging.correct(points, sites, "terrain").collect()}
    monkeypatch.setattr(kriging, "BROADCAST_SITES", 3)
    two = {r.point_id: r for r in kriging.correct(points, sites, "terrain").collect()}
    assert one.keys() == two.keys() and one[900].terrain_mvn_vs30 is None and two[900].terrain_mvn_vs30 is None
    for k in range(200):
        assert one[k].terrain_mvn_vs30 == pytest.approx(two[k].terrain_mvn_vs30, rel=1e-9)


def test_site_with_small_uncertainty_is_met():
    site = np.array([[0.0, 0.0, 279.8343, 1e-6, 400.0, 0.5]])
    v, _ = kriging.conditioned(np.zeros(1), np.zeros(1), np.array([400.0]), np.array([0.5]), site, 1407.0)
    assert v[0] == pytest.approx(279.8343, rel=1e-3)


def test_soil_parameters_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(1, k + 1, 0.1 * (k + 1), float(rng.uniform(0.01, 20)), float(rng.uniform(0.001, 0.2)), float(rng.uniform(0, 0.1)), 1.0, 0.8) for k in range(300)]
    got = cpt.soil_parameters(spark.createDataFrame(rows, "cpt_id long, pos int, depth double, qc double, fs double, u double, gwl double, nar double")).orderBy("pos").collect()
    total, last = 0.0, 0.0
    for i, r in enumerate(rows):
        _, _, d, qc, fs, u, _, _ = r
        qt = qc + u * (1 - 0.8)
        gamma = max(0.014, 9.80665 / 1000 * (0.27 * math.log10(100 * fs / qt) + 0.36 * math.log10(qt / 0.1) + 1.236))
        total += gamma * (d - last)
        last = d
        eff = total - (0.00981 * (d - 1) if i and d >= 1 else 0)
        fr, n, ic, q = fs / (qt - total) * 100, 0.5, None, None
        while True:
            q = (qt - total) / 0.1 * min(1.7, (0.1 / eff) ** n)
            ic = math.sqrt((3.47 - math.log10(q)) ** 2 + (math.log10(fr) + 1.22) ** 2) if q > 0 and fr > 0 else None
            new = min(1, 0.381 * ic + 0.05 * eff / 0.1 - 0.15) if ic is not None else None
            done = new is None or abs(n - new) < 0.01
            n = new
            if done:
                break
        assert got[i]["eff_stress"] == pytest.approx(eff, rel=1e-9)
        assert got[i]["qtn"] == pytest.approx(q, rel=1e-9)
        assert (got[i]["ic"] is None) == (ic is None) and (ic is None or got[i]["ic"] == pytest.approx(ic, rel=1e-9))


def test_errors_are_raised(spark):
    bad = spark.createDataFrame([(1, 1, 0.1, 0.0, 0.1, 0.0, 1.0, 0.8)], "cpt_id long, pos int, depth double, qc double, fs double, u double, gwl double, nar double")
    with pytest.raises(Exception, match="no valid rows"):
        cpt.info(bad).collect()
    with pytest.raises(KeyError):
        cpt.profiles(bad, ["unheard_of"])
    hole = spark.createDataFrame([(1, 1, 1.0, 5.0, "Sand", "Steam", 100.0, None)], "spt_id long, pos int, depth double, n double, soil string, hammer string, diameter double, energy_ratio double")
    with pytest.raises(Exception, match="unknown hammer"):
        spt.n60(hole).select("hammer").collect()
    weights = spark.createDataFrame([("vs", "a", 0.5), ("vs", "b", 0.4)], "kind string, key string, weight double")
    with pytest.raises(Exception, match="close enough"):
        ensemble.normalised(weights).collect()


def _profile(spark, rows):
    return spark.createDataFrame([(1, k + 1, *r) for k, r in enumerate(rows)], "id long, pos int, depth double, vs double, vs_sd double")


@pytest.mark.parametrize(("depths", "want"), [([1.0, 2.0, 3.0], [1, 2, 3]), ([1.0, 2.0, 3.4], [1, 2, 3]), ([1.0, 2.9, 3.05], [1, 2.9, 3]), ([10.0, 29.0, 31.5], [10, 29, 30]), ([10.0, 30.0, 31.5], [10, 30])])
def test_truncate(spark, depths, want):
    rows = profile.truncate(_profile(spark, [(d, 100.0 * (k + 1), 0.1 * k) for k, d in enumerate(depths)]), ("id",)).orderBy("pos").collect()
    assert [r.depth for r in rows] == want
    if depths == [10.0, 29.0, 31.5]:  # the middle is past 30, so the row moved up takes its upper neighbour's velocity
        assert rows[-1].vs == 200.0
    if depths == [1.0, 2.9, 3.05]:
        assert rows[-1].vs == 300.0


def test_layers_with_leading_zero(spark):
    rows = profile.layers(_profile(spark, [(1.0, 0.0, 0.1), (2.0, 150.0, 0.1), (4.0, 300.0, 0.1)]), ("id",)).orderBy("pos").collect()
    assert [(r.z_top, r.z_bot, r.vs) for r in rows] == [(0.0, 3.0, 150.0), (3.0, 4.0, 300.0)]


def test_uniform_profile_and_missing_layer(spark):
    cut = profile.truncate(_profile(spark, [(float(d), 240.0, 0.1) for d in range(1, 13)]), ("id",))
    assert profile.vsz(cut, ("id",)).first().vsz == pytest.approx(240.0)
    holed = cut.withColumn("vs", F.when(F.col("pos") != 5, F.col("vs")))
    assert profile.vsz(holed, ("id",)).first().vsz is None


def test_vs30_of_shallow_and_unknown(spark):
    one = spark.createDataFrame([(1, 4, 200.0, "boore_2011")], "id long, z int, vsz double, vs30_correlation string")
    with pytest.raises(Exception, match="not deep enough"):
        profile.vs30(one).collect()
    with pytest.raises(Exception, match="unknown vs30"):
        profile.vs30(one.withColumn("vs30_correlation", F.lit("x"))).collect()


def test_average_profile_bridges_gaps(spark):
    rows = [("a", 1, 1.0, 200.0, 0.1, 1.0), ("a", 2, 2.0, 200.0, 0.1, 1.0), ("b", 1, 3.0, 300.0, 0.2, 1.0), ("b", 2, 4.0, 300.0, 0.2, 1.0)]
    curve = ensemble.average_profile(spark.createDataFrame(rows, "name string, pos int, depth double, vs double, vs_sd double, weight double"), ("name",)).orderBy("point").collect()
    assert curve[0].depth == 0.0 and curve[0].vs == 200.0
    middle = [(r.depth, r.vs) for r in curve if 2.1 < r.depth < 2.9]
    assert [(round(d, 6), v) for d, v in middle] == [(2.5, 200.0), (2.5, 300.0)]


def test_posterior_is_the_sequential_update(spark):
    rng = np.random.default_rng(3)
    obs = [(int(i), float(v), float(u)) for i, v, u in zip(rng.integers(1, 4, 40), rng.uniform(150, 800, 40), rng.choice([0.1, 0.2, 0.5], 40))]
    got = {r.id: r for r in models.posterior(models.table(spark, "geology"), spark.createDataFrame(obs, "gid int, vs30 double, uncertainty double"), "gid").collect()}
    for k in (1, 2, 3, 9):
        mu, sd = models.GEOLOGY_PRIOR[k - 1]
        sd, n = max(sd, 0.5), 3
        for i, v, u in obs:
            if i == k:
                var = (n * sd * sd + u * u) / (n + 1)
                mu, sd, n = math.exp((n / var * math.log(mu) + math.log(v) / var) / (n / var + 1 / var)), math.sqrt(var), n + 1
        assert got[k].vs30 == pytest.approx(mu, rel=1e-12) and got[k].stdv == pytest.approx(sd, rel=1e-12)


def test_combination_of_equals_is_identity(spark):
    one = spark.range(1).select(*[F.lit(x).alias(n) for n, x in (("a", 300.0), ("s", 0.4))])
    for by_variance in (False, True):
        v, s = one.select(*models.combine(F.col("a"), F.col("s"), F.col("a"), F.col("s"), by_variance)).first()
        assert v == pytest.approx(300.0) and s == pytest.approx(0.4)


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.normal(c, 3_000, (25, 2)) for c in (0, 30_000, 90_000)] + [rng.uniform(-50_000, 150_000, (20, 2))])
    rows = [(i, float(x), float(y), 1 + i % 2) for i, (x, y) in enumerate(xy)] + [(900, 0.0, 0.0, None), (901, 0.0, 0.0, 7)]
    got = {r.site_id: r.cluster for r in cluster.dbscan(spark.createDataFrame(rows, "site_id long, easting double, northing double, gid int"), "gid", eps=6_000.0).collect()}
    assert got[900] == -1 and got[901] == -1
    for g in (1, 2):
        own = [r for r in rows if r[3] == g]
        near = {a[0]: [b[0] for b in own if math.hypot(a[1] - b[1], a[2] - b[2]) <= 6_000] for a in own}
        core = sorted(k for k, v in near.items() if len(v) >= 5)
        label, number = {}, 0
        for k in core:
            if k in label:
                continue
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = number
                    todo += [b for b in near[x] if b in core]
            number += 1
        for k in near:
            want = label.get(k, min((label[b] for b in near[k] if b in label), default=-1))
            assert got[k] == want


def test_nztm_known_values(spark):
    east, north = projection.nztm(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(173.0, -41.0), (173.0, 0.0), (174.0, -36.0), (172.0, -36.0)], "lon double, lat double").select(east.alias("e"), north.alias("n")).collect()
    assert rows[0].e == pytest.approx(1_600_000, abs=1e-6) and rows[1].n == pytest.approx(10_000_000, abs=1e-6)
    assert rows[2].e + rows[3].e == pytest.approx(3_200_000, abs=1e-6) and rows[2].n == pytest.approx(rows[3].n, abs=1e-6)


def _nzmg_forward(lon, lat):
    """The published forward series, on the grid's own datum."""
    a = (0.6399175073, -0.1358797613, 0.063294409, -0.02526853, 0.0117879, -0.0055161, 0.0026906, -0.001333, 0.00067, -0.00034)
    dphi = (lat + 41) * 3600 * 1e-5
    zeta = complex(sum(c * dphi ** (k + 1) for k, c in enumerate(a)), math.radians(lon - 173))
    z = sum(c * zeta ** (k + 1) for k, c in enumerate(projection.NZMG_B))
    return 2_510_000 + z.imag * 6378388, 6_023_150 + z.real * 6378388


def test_map_grid_inverse_undoes_the_forward_series(spark):
    places = [(172.7, -34.4), (176.9, -39.5), (168.0, -46.3), (173.0, -41.0)]
    df = spark.createDataFrame([(*p, *_nzmg_forward(*p)) for p in places], "lon double, lat double, x double, y double")
    out = df.withColumns(projection.nzmg_columns(F.col("x"), F.col("y")))
    for _ in range(2):
        out = out.withColumns(projection.refine_nzmg())
    lon, lat = projection.nzmg_geodetic()
    for r in out.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=2e-6) and r.b == pytest.approx(r.lat, abs=2e-6)
    moved = spatial.from_map_grid(df, "x", "y").select("lon", "lat", "easting", "northing").collect()
    for r in moved:  # the two datums lie some 200 m apart
        e, n = spark.range(1).select(*projection.nztm(F.lit(r.lon), F.lit(r.lat))).first()
        assert 50 < math.hypot(r.easting - e, r.northing - n) < 400


def test_polygon_with_a_notch(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    edges = spark.createDataFrame([(3, 0, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "gid int, feature_ord int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 6.0), (3, 1.0, 8.0), (4, -1.0, 2.0), (5, None, None)], "point_id long, easting double, northing double")
    got = {r.point_id: r.gid for r in spatial.in_polygons(points, edges, 3.0).collect()}
    assert got == {1: 3, 2: None, 3: 3, 4: None, 5: None}


def test_grid_grows_by_whole_cells():
    grid = Grid.over(1000, 2000, 1000, 2000, 100, 100)
    assert (grid.nx, grid.ny) == (10, 10)
    wide = grid.covering(950, 2350, 1000, 2000)
    assert (wide.x0, wide.nx, wide.ny) == (900, 15, 10)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=2, max_size=6))
def test_numpy_rounding_reference(values):
    from geovelo.operators.raster import Grid

    g = Grid.over(0, max(values) + 1, 0, 1, 1, 1)
    assert g.nx == round(max(values) + 1)


def test_coast_rings_equal_the_nearest_sea(spark):
    grid = Grid(0.0, 0.0, 1000.0, -1000.0, 40, 30)
    sea = lambda r, c: c < 3 or (r - 10) ** 2 + (c - 30) ** 2 < 4
    land = spark.createDataFrame([(r, c, 0.0 if sea(r, c) else 1.0) for r in range(30) for c in range(40)], "row int, col int, value double")
    got = {(r.row, r.col): r.distance for r in raster.coast_distance(land, grid, 8_000.0).collect()}
    wet = [(r, c) for r in range(30) for c in range(40) if sea(r, c)]
    for (r, c), d in got.items():
        assert d == pytest.approx(min(8_000, min(1000 * math.hypot(r - a, c - b) for a, b in wet)))
    assert len(got) == 1200 - len(wet)


def _brute_dbscan(rows, eps, least):
    """{site_id: cluster} of (site_id, id, x, y), by comparison of all with all."""
    near = {a[0]: [b[0] for b in rows if a[1] == b[1] and np.hypot(a[2] - b[2], a[3] - b[3]) <= eps] for a in rows}
    core = {k for k, v in near.items() if len(v) >= least}
    label = {}
    for k in sorted(core):
        todo = [k] if k not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += [y for y in near[x] if y in core]
    for k, v in near.items():
        if k not in core:
            reached = [label[x] for x in v if x in core]
            if reached:
                label[k] = min(reached)
    ids = {r[0]: r[1] for r in rows}
    ranks = {c: sorted({v for k, v in label.items() if ids[k] == c}) for c in set(ids.values())}
    return {k: ranks[ids[k]].index(label[k]) if k in label else -1 for k in ids}


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_brute_force(spark, seed):
    """Dense and sparse cells, cells that face each other just within or beyond eps, repeated places."""
    rng = np.random.default_rng(seed)
    spots = rng.uniform(-60, 60, (12, 2))
    rows = []
    for k, (x, y) in enumerate(spots):
        for _ in range(int(rng.integers(1, 40))):
            rows.append((x + rng.normal(0, rng.choice([0, 1, 4])), y + rng.normal(0, 3)))
    # two walls of sites eps apart, but for one gap in the second half of the runs
    rows += [(200.0, 0.01 * k) for k in range(120)] + [(210.0 + (1e-7 if seed % 2 else 0), 40 + 0.01 * k) for k in range(120)] + [(205.0, 33.0 + k) for k in range(3) if seed > 1]
    rows += [(300 + 10.0 * i, 10.0 * j) for i in range(6) for j in range(6)]
    told = [(k, int(k % 2 if k < 60 else 1), float(x), float(y)) for k, (x, y) in enumerate(rows)]
    odd = [(9000, None, 0.0, 0.0), (9001, 255, 0.0, 0.0), (9002, 1, None, 0.0)]
    got = cluster.dbscan(spark.createDataFrame([*told, *odd], "site_id long, gid int, easting double, northing double"), "gid", 5, 10.0).collect()
    want = _brute_dbscan(told, 10.0, 5) | {k: -1 for k, *_ in odd}
    assert {r.site_id: r.cluster for r in got} == want


def test_two_hot_cells_are_linked_without_pairs(spark):
    """20,000 sites in each of two cells, of which only the last halving tells that none are within eps."""
    k = F.col("id")
    left = spark.range(20_000).select(k.alias("site_id"), F.lit(1).alias("gid"), (-(k % 100) * 0.01).alias("easting"), (k / 20_000).alias("northing"))
    far = lambda gap: left.select((F.col("site_id") + 50_000).alias("site_id"), "gid", (F.lit(10.0 + gap) + F.col("site_id") % 100 * 0.01).alias("easting"), "northing")
    apart = cluster.dbscan(left.unionByName(far(0.0005)), "gid", 5, 10.0).groupBy("cluster").count().collect()
    assert sorted(map(tuple, apart)) == [(0, 20_000), (1, 20_000)]
    together = cluster.dbscan(left.unionByName(far(0.0)), "gid", 5, 10.0).groupBy("cluster").count().collect()
    assert sorted(map(tuple, together)) == [(0, 40_000)]


@pytest.mark.parametrize(("nx", "ny", "dx", "dy", "cap"), [(70, 50, 100.0, -100.0, 1500.0), (300, 40, 50.0, -80.0, 700.0), (9, 1, 10.0, -10.0, 35.0), (400, 3, 25.0, -25.0, 2000.0)])
def test_coast_distances_equal_brute_force(spark, monkeypatch, nx, ny, dx, dy, cap):
    monkeypatch.setattr(raster, "BLOCK", 3000 if ny > 5 else 30)
    rng = np.random.default_rng(nx)
    grid = raster.Grid(0.0, 0.0, dx, dy, nx, ny)
    rows = [(r, c, float(rng.choice([0, 1], p=[0.01, 0.99])) if c < nx * 0.8 else 1.0) for r in range(ny) for c in range(nx) if (r + c) % 37]
    rows = [(r, c, None if v == 0 and (r + c) % 2 else v) for r, c, v in rows]
    sea = np.array([(c * dx, r * dy) for r, c, v in rows if not v])
    got = {(r.row, r.col): r.distance for r in raster.coast_distance(spark.createDataFrame(rows, "row int, col int, value double").repartition(3), grid, cap).collect()}
    land = [(r, c) for r, c, v in rows if v]
    assert set(got) == set(land)
    for r, c in land:
        want = min(cap, np.hypot(sea[:, 0] - c * dx, sea[:, 1] - r * dy).min()) if len(sea) else cap
        assert got[r, c] == pytest.approx(want, abs=1e-6)


def test_coast_distances_without_sea_or_land(spark):
    grid = raster.Grid(0.0, 0.0, 10.0, -10.0, 3, 1)
    table = lambda rows: spark.createDataFrame(rows, "row int, col int, value double")
    assert [r.distance for r in raster.coast_distance(table([(0, 0, 1.0), (0, 2, 1.0)]), grid, 25.0).collect()] == [25.0, 25.0]
    assert raster.coast_distance(table([(0, 0, 0.0), (0, 1, None)]), grid).count() == 0
    assert raster.coast_distance(table([]), grid).count() == 0


def _odd_even(x, y, edges):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_polygons_by_cells_equal_the_parity_of_all_edges(spark, cell):
    """Jagged, overlapping polygons with holes, horizontal and upright sides, corners on cell borders, and points on corners, sides and cell borders."""
    rng = np.random.default_rng(3)
    rings = {}
    for gid in range(1, 7):
        n = int(rng.integers(3, 25))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        reach, at = rng.uniform(1, 8, n), rng.uniform(-6, 6, 2)
        corners = np.column_stack((at[0] + reach * np.cos(angle), at[1] + reach * np.sin(angle)))
        rings[gid] = [np.round(corners, int(rng.integers(0, 3))).tolist()]
    rings[7] = [[[-6, -6], [6, -6], [6, 6], [-6, 6]], [[-3, -3], [0, -3], [0, 3], [-3, 3]]]
    rings[8] = [[[0.7, 0.7], [2.1, 0.7], [2.1, 1.4], [2.8, 1.4], [2.8, 2.1], [0.7, 2.1]]]
    edges = [(g, g, *map(float, a), *map(float, b)) for g, told in rings.items() for ring in told for a, b in zip(ring, ring[1:] + ring[:1])]
    spots = [*map(tuple, rng.uniform(-15, 15, (400, 2))), *[(float(x) * 0.5, float(y) * 0.5) for x in range(-14, 15) for y in range(-14, 15)], *[(e[2], e[3]) for e in edges], *[((e[2] + e[4]) / 2, (e[3] + e[5]) / 2) for e in edges], *[(0.7 * k, 0.35 * j) for k in range(6) for j in range(6)]]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "point_id long, easting double, northing double")
    table = spark.createDataFrame(edges, "gid int, feature_ord int, x1 double, y1 double, x2 double, y2 double")
    inside = [[g for g in rings if _odd_even(x, y, [e[2:] for e in edges if e[0] == g])] for x, y in spots]
    assert {r.point_id: r.gid for r in spatial.in_polygons(points, table, cell).collect()} == {k: min(v, default=None) for k, v in enumerate(inside)}
    assert {r.point_id: r.gid for r in spatial.in_polygons(points, table, cell, last=True).collect()} == {k: max(v, default=None) for k, v in enumerate(inside)}


def test_points_in_inner_cells_meet_no_edges(spark):
    square = [(1, 0, 0.0, 0.0, 100.0, 0.0), (1, 0, 100.0, 0.0, 100.0, 100.0), (1, 0, 100.0, 100.0, 0.0, 100.0), (1, 0, 0.0, 100.0, 0.0, 0.0)]
    cells, pieces = spatial.cover(spark.createDataFrame(square, "gid int, feature_ord int, x1 double, y1 double, x2 double, y2 double"), 7.0)
    inner = {(r._1, r._2) for r in cells.where("NOT border").select(F.col("_cx").alias("_1"), F.col("_cy").alias("_2")).collect()}
    touched = {(r[0], r[1]) for r in pieces.select("_cx", "_cy").collect()}
    assert inner == {(x, y) for x in range(1, 14) for y in range(1, 14)} and not inner & touched


@pytest.mark.parametrize("most", [1, 3, 70])
def test_nearest_sites_where_they_are_dense(spark, most):
    rng = np.random.default_rng(most)
    places = [*rng.uniform(0, 300, (150, 2)), *(rng.normal(0, 0.01, (500, 2)) + 120), *(rng.normal(0, 5, (300, 2)) + 200), *[(50.0, 50.0)] * 90, *[(60.0, 50.0), (40.0, 50.0), (50.0, 60.0)] * 2]
    sites = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)] + [(9999, None, 1.0)], "site_id long, easting double, northing double")
    spots = [*rng.uniform(-20, 320, (60, 2)), (120.0, 120.0), (50.0, 50.0), (50.0, 70.0), (1e6, 0.0)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "point_id long, easting double, northing double")
    got = {(r.point_id, r.s_site_id) for r in spatial.neighbours(points, sites, 100.0, most).collect()}
    xy, want = np.array(places), set()
    for k, (x, y) in enumerate(spots):
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        near = np.sort(d[d <= 100])
        if len(near):
            want |= {(k, int(i)) for i in np.flatnonzero(d <= near[min(most, len(near)) - 1])}
    assert got == want


def test_correction_in_turn_equals_the_solve(spark):
    rng = np.random.default_rng(9)
    rows = [(k, *map(float, r)) for k, r in enumerate(_random_sites(rng, 120))]
    sites = spark.createDataFrame(rows, "site_id long, easting double, northing double, vs30 double, uncertainty double, geology_vs30 double, geology_stdv double")
    spots = [(k, float(x), float(y), float(v), float(s)) for k, (x, y, v, s) in enumerate(zip(rng.uniform(-15_000, 45_000, 200), rng.uniform(0, 30_000, 200), rng.uniform(150, 700, 200), rng.uniform(0.2, 0.6, 200)))]
    spots += [(900, 1000.0, 1000.0, None, None), (901, None, 1.0, 300.0, 0.4), (902, 1e7, 1e7, 300.0, 0.4)]
    points = spark.createDataFrame(spots, "point_id long, easting double, northing double, geology_vs30 double, geology_stdv double")
    for most in (1, 8):
        whole = {r.point_id: r for r in kriging.correct(points, sites, "geology", most).collect()}
        turns = {r.point_id: r for r in kriging.correct_in_turn(points, sites, "geology", most).collect()}
        assert set(whole) == set(turns) == {p[0] for p in spots}
        for k, r in whole.items():
            assert turns[k].geology_mvn_vs30 == (None if r.geology_mvn_vs30 is None else pytest.approx(r.geology_mvn_vs30, rel=1e-9)) and turns[k].geology_mvn_stdv == (None if r.geology_mvn_stdv is None else pytest.approx(r.geology_mvn_stdv, rel=1e-9))
    assert "Python" not in kriging.correct_in_turn(points, sites, "geology")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="in turn"):
        kriging.correct_in_turn(points, sites, "geology", 100)


def test_correction_in_turn_looks_at_a_place_once(spark):
    rng = np.random.default_rng(10)
    rows = [(k, *map(float, r)) for k, r in enumerate(_random_sites(rng, 60))]
    sites = spark.createDataFrame(rows, "site_id long, easting double, northing double, vs30 double, uncertainty double, geology_vs30 double, geology_stdv double")
    # few places, each with several priors, and ids that stand on several places
    spots = [(k % 5, float(x), float(y), v, 0.4 + v / 1e4) for k, (x, y) in enumerate(rng.uniform(0, 30_000, (12, 2)).tolist()) for v in (200.0, 200.0, 300.0, 451.0)]
    points = spark.createDataFrame(spots, "point_id long, easting double, northing double, geology_vs30 double, geology_stdv double")
    told = lambda out: sorted(tuple(r) for r in out.collect())
    got, want = told(kriging.correct_in_turn(points, sites, "geology", 6)), told(kriging.correct(points, sites, "geology", 6))
    assert len(got) == len(spots)
    assert np.allclose(np.array(got, float), np.array(want, float), rtol=1e-9)


def test_few_steps_and_many_steps_settle_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(1, k + 1, 0.1 * (k + 1), float(rng.uniform(0.01, 20)), float(rng.uniform(0.001, 0.2)), float(rng.uniform(0, 0.1)), 1.0, 0.8) for k in range(400)] + [(2, 1, None, 1.0, 0.1, 0.0, 1.0, 0.8)]
    table = spark.createDataFrame(rows, "cpt_id long, pos int, depth double, qc double, fs double, u double, gwl double, nar double")
    got = []
    for steps in (4, 1, 0):
        monkeypatch.setattr(cpt, "UNROLLED", steps)
        got.append(cpt.soil_parameters(table).orderBy("cpt_id", "pos").collect())
    assert got[0] == got[1] == got[2]
    with pytest.raises(Exception, match="did not settle"):
        cpt.soil_parameters(table, 1).collect()


def test_points_at_one_place_are_solved_once(monkeypatch):
    rng = np.random.default_rng(3)
    sites = _random_sites(rng, 300, 12_000)
    places = rng.uniform(0, 12_000, (9, 2))
    at = rng.integers(0, 9, 400)
    v, s = rng.choice([200.0, 300.0, 500.0], 400), rng.choice([0.3, 0.5], 400)
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: solved.append(len(a)) or solve(a, b))
    for shared, priors in ((kriging.SHARED, kriging.PRIORS), (10_000, 2)):  # sites of all places at once, or of fewer; all priors at once, or two
        monkeypatch.setattr(kriging, "SHARED", shared)
        monkeypatch.setattr(kriging, "PRIORS", priors)
        solved.clear()
        got = np.array(kriging.conditioned(*places[at].T, v, s, sites, 1407.0)).T
        assert sum(solved) == (9 if priors > 2 else 27)
        want = {(k, a, b): _mvn(*places[k], a, b, sites, 1407.0) for k, a, b in set(zip(at.tolist(), v.tolist(), s.tolist()))}
        np.testing.assert_allclose(got, [want[key] for key in zip(at.tolist(), v.tolist(), s.tolist())], rtol=1e-7)


@pytest.mark.parametrize("noisy", [True, False])
def test_sites_that_all_places_use_are_eliminated_once(monkeypatch, noisy):
    rng = np.random.default_rng(6)
    sites = np.concatenate((_random_sites(rng, 200, 9_000), _random_sites(rng, 300, 30_000)))
    if not noisy:
        sites[:, 3] = 0.0
    x, y = rng.uniform(4_000, 5_500, (2, 40))
    v, s = rng.uniform(150, 700, 40), rng.uniform(0.2, 0.6, 40)
    sizes, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(a.shape[-1]) or solve(a, b))
    got = np.array(kriging.conditioned(x, y, v, s, sites, 1407.0)).T
    least = min((np.hypot(sites[:, 0] - a, sites[:, 1] - b) <= kriging.REACH).sum() for a, b in zip(x, y))
    assert least > 200 and max(sizes) < 100
    np.testing.assert_allclose(got, [_mvn(*p, sites, 1407.0) for p in zip(x, y, v, s)], rtol=1e-7)
    # sites around one corner only: the other places use none of them, so nothing is shared
    far = np.array(kriging.conditioned(np.r_[x, 60_000.0], np.r_[y, 60_000.0], np.r_[v, 300.0], np.r_[s, 0.5], sites, 1407.0)).T
    np.testing.assert_allclose(far[:40], got, rtol=1e-9)
    assert far[40] == pytest.approx((300.0, 0.5 * math.exp(-0.05 / 1407)))


def test_tasks_follow_the_rows(spark, monkeypatch):
    from geovelo import shared
    from geovelo.plans import fixtures

    monkeypatch.setattr(shared, "ROWS", 600)
    lines = fixtures.read(spark, "/root/testdata/sf0.001", "lineitem")
    for table in (fixtures.soundings(spark, "/root/testdata/sf0.001"), cpt.profiles(cpt.valid(fixtures.soundings(spark, "/root/testdata/sf0.001", 1.0, 0.01)), ["mcgann_2015"])):
        assert table.rdd.getNumPartitions() == -(-lines.count() // 600) > 4


@pytest.mark.parametrize("most", [10, 1])
def test_weights_by_broadcast_and_by_name(spark, monkeypatch, most):
    monkeypatch.setattr(ensemble, "BROADCAST_WEIGHTS", most)
    weights = spark.createDataFrame([("profile", "a", 0.3), ("profile", "b", 0.7)], "kind string, key string, weight double")
    rows = spark.createDataFrame([("a", None, None), ("b", None, None)], "name string, vs_correlation string, vs30_correlation string")
    out = ensemble.weighted(rows, weights)
    assert {r.name: round(r.weight, 9) for r in out.collect()} == {"a": 0.3, "b": 0.7}
    assert ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == (most == 10)


@pytest.mark.parametrize("most", [1, 3])
def test_sites_by_search_and_by_joins(spark, monkeypatch, most):
    rng = np.random.default_rng(8)
    table = lambda name, n: spark.createDataFrame([(k, *map(float, rng.integers(0, 300, 2))) for k in range(n)] + [(9999, None, 1.0)], f"{name} long, easting double, northing double")
    points, sites = table("point_id", 150).cache(), table("site_id", 300).cache()
    told = []
    for limit in (400_000, 10):
        monkeypatch.setattr(spatial, "SEARCHED", limit)
        near, one, every = spatial.neighbours(points, sites, 40.0, most), spatial.nearest(points, sites, 40.0), spatial.within(points, sites, 40.0)
        assert ("Join" in near._jdf.queryExecution().optimizedPlan().toString()) == (limit == 10)
        told.append([{(r.point_id, r.s_site_id, round(r.distance, 9)) for r in x.collect()} for x in (near, one, every)])
    assert told[0] == told[1] and len(told[0][1]) == 150
