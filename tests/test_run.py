"""A whole run from text files to tables and rasters."""

import glob
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from geovelo.operators.raster import Grid
from geovelo.plans import pipeline, run
from geovelo.sources import polygons, sites

SF = "/root/testdata/sf0.001"
POINTS = "longitude latitude easting northing gid geology_vs30 geology_stdv geology_mvn_vs30 geology_mvn_stdv tid terrain_vs30 terrain_stdv terrain_mvn_vs30 terrain_mvn_stdv vs30 stdv mvn_vs30 mvn_stdv".split()
SITES = "easting northing vs30 uncertainty station q gid geology_vs30 geology_stdv tid terrain_vs30 terrain_stdv".split()


def _files(folder):
    (folder / "graded.ll").write_text('# comment\n"Station", "Lon" , "Lat", "Vs30", "Q"\n"014A", 172.6, -43.5, 250, "Q2"\n"ABC", 172.7, -43.4, 400, "Q3"\n"LONG", 172.8, -43.4, 300, "Q3"\n')
    (folder / "tabbed.csv").write_text("ID\tSite\tLat\tLong\tVs30\n1\tClub\t-43.48\t172.53\t434.8\n")
    (folder / "cpt.ssv").write_text("e n v\n" + "".join(f"{1_560_000 + 100 * k} {5_180_000 + 50 * k} {200 + k}\n" for k in range(8)) + "1570000 5180000 NA\n")
    (folder / "ll.txt").write_text("lon lat\n172.6 -43.5\n172.65 -43.45\n10.0 -43.4\n")
    (folder / "edges.tsv").write_text("gid\tgeometry\n2\tPOLYGON ((1550000 5160000, 1590000 5160000, 1590000 5200000, 1550000 5200000, 1550000 5160000), (1552000 5162000, 1553000 5162000, 1553000 5163000, 1552000 5162000))\n7\tPOLYGON EMPTY\n")
    return sites.SiteFiles(tabbed=str(folder / "tabbed.csv"), graded=str(folder / "graded.ll"), cpt=str(folder / "cpt.ssv"))


def _terrain(spark, grid):
    row, col = F.floor(F.col("id") / grid.nx).cast("int"), (F.col("id") % grid.nx).cast("int")
    return spark.range(grid.nx * grid.ny).select(row.alias("row"), col.alias("col"), ((row * 31 + col * 17) % 16 + 1).cast("double").alias("value"))


def _layers(spark, folder):
    grid = Grid(1_500_000, 5_300_000, 5000.0, -5000.0, 40, 40)
    return pipeline.Layers(polygons.read_polygons(spark, str(folder / "edges.tsv")), _terrain(spark, grid), grid)


def _header(path):
    return open(glob.glob(f"{path}/part-*.csv")[0]).readline().strip().split(",")


def test_run_at_points(spark, tmp_path):
    options = run.Options(str(tmp_path / "out"), _files(tmp_path), locations=run.Locations(str(tmp_path / "ll.txt"), skip_rows=1))
    out = run.run(spark, options, _layers(spark, tmp_path))
    assert _header(tmp_path / "out" / "vs30points.csv") == POINTS and _header(tmp_path / "out" / "measured_sites.csv") == SITES
    rows = spark.read.option("header", True).option("nullValue", "NA").option("inferSchema", True).csv(str(tmp_path / "out" / "vs30points.csv")).orderBy("longitude").collect()
    assert [r.gid for r in rows] == [255, 2, 2] and rows[0].vs30 is None
    for r, e in zip(rows, out.orderBy("longitude").collect(), strict=True):
        assert r.mvn_vs30 == pytest.approx(e.mvn_vs30) and r.mvn_stdv == pytest.approx(e.mvn_stdv)
    known = spark.read.option("header", True).option("nullValue", "NA").csv(str(tmp_path / "out" / "measured_sites.csv"))
    assert sorted(str(r.station) for r in known.collect()) == ["014A", "ABC", "None"]
    with pytest.raises(Exception, match="(?i)exists"):
        run.run(spark, options, _layers(spark, tmp_path))


def test_run_over_a_grid_with_clusters(spark, tmp_path):
    grid = Grid.over(1_555_000, 1_575_000, 5_170_000, 5_190_000, 2000, 2000)
    settings = pipeline.Settings(geology="posterior", terrain="off")
    options = run.Options(str(tmp_path / "out"), _files(tmp_path), source="cpt", grid=grid, settings=settings)
    run.run(spark, options, _layers(spark, tmp_path))
    assert _header(tmp_path / "out" / "measured_sites.csv") == [c for c in SITES if not c.startswith(("t", "tid"))] + ["gcluster"]
    for name in ("geology", "geology_mvn"):
        band = sites.read_raster(spark, str(tmp_path / "out" / name))
        assert band.count() == 100 and band.columns == ["row", "col", "vs30", "stdv"]
    assert not (tmp_path / "out" / "combined").exists()
    with pytest.raises(ValueError, match="unknown site source"):
        sites.load_vs(spark, options.files, "other")


def test_repeated_sites_get_ids_of_their_own(spark, tmp_path):
    one = sites.cpt_sites(spark, _files(tmp_path).cpt)
    ids = [r.site_id for r in sites.union(one, one).collect()]
    assert len(ids) == 16 == len(set(ids))
    assert sorted(ids) == sorted(r.site_id for r in sites.union(one.repartition(3), one).collect())


def test_polygon_texts_agree(spark):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((5 5, 6 5, 6 6)))"
    js = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]],[[[5,5],[6,5],[6,6]]]]}'
    one = '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1]]]}'
    rows = spark.createDataFrame([(1, 0, wkt, js), (2, 1, None, one), (3, 2, "POINT EMPTY", '{"type": "Point", "coordinates": [1, 2]}'), (4, 3, "POLYGON ((0 0, 1 0, 1 1))", None)], "gid int, feature_ord long, w string, j string")
    told = polygons.edges(rows, polygons.wkt_rings(F.col("w"))).collect()
    same = polygons.edges(rows, polygons.geojson_rings(F.col("j"))).collect()
    assert sorted(r[2:] for r in told if r.gid == 1) == sorted(r[2:] for r in same if r.gid == 1) and len([r for r in told if r.gid == 1]) == 9
    assert {(r.gid, len([x for x in told if x.gid == r.gid])) for r in told} == {(1, 9), (4, 3)} and {r.gid for r in same} == {1, 2}


def _grid_options(folder, **how):
    grid = Grid.over(1_555_000, 1_575_000, 5_170_000, 5_190_000, 2000, 2000)
    return run.Options(str(folder / "out"), _files(folder), source="cpt", grid=grid, settings=pipeline.Settings(terrain="off"), **how)


def test_a_run_that_ends_early_leaves_nothing_and_is_taken_up(spark, tmp_path, monkeypatch):
    from geovelo.sources import sites as sources

    options, layers = _grid_options(tmp_path), _layers(spark, tmp_path)
    written, write = [], sources.write_raster

    def lost(band, path, **how):
        written.append(path)
        if len(written) == 2:
            raise RuntimeError("lost")
        write(band, path, **how)

    monkeypatch.setattr(sources, "write_raster", lost)
    with pytest.raises(RuntimeError, match="lost"):
        run.run(spark, options, layers)
    assert not (tmp_path / "out").exists()
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "out._staged" / "estimates").iterdir()}
    out = run.run(spark, options, layers)
    assert [p.rsplit("/", 1)[1] for p in written] == ["geology", "geology_mvn", "geology_mvn"] and out.count() == 100
    assert {p.name: t for p, t in first.items()} == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out" / "estimates").iterdir()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["estimates", "geology", "geology_mvn", "measured_sites.csv"] and not (tmp_path / "out._staged").exists()
    # refused at once, before a file is written
    with pytest.raises(FileExistsError):
        run.run(spark, options, layers)
    assert len(written) == 3 and not (tmp_path / "out._staged").exists()


def test_another_run_starts_anew_and_may_overwrite(spark, tmp_path, monkeypatch):
    from geovelo.sources import sites as sources

    options = _grid_options(tmp_path)
    layers, write, over = _layers(spark, tmp_path), sources.write_csv, replace(options, overwrite=True)
    run.run(spark, options, layers)
    before = spark.read.parquet(str(tmp_path / "out" / "estimates")).orderBy("point_id").collect()
    monkeypatch.setattr(sources, "write_csv", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run.run(spark, over, layers)
    assert spark.read.parquet(str(tmp_path / "out" / "estimates")).orderBy("point_id").collect() == before
    monkeypatch.setattr(sources, "write_csv", write)
    with (tmp_path / "cpt.ssv").open("a") as f:
        f.write("1560000 5175000 900\n")
    again = run.run(spark, over, layers).orderBy("point_id").collect()
    assert len(again) == len(before) and again != before


def test_a_run_to_geotiff_blocks(spark, tmp_path):
    from geovelo.sources import tiles

    options = _grid_options(tmp_path, tiles=True)
    out = run.run(spark, options, _layers(spark, tmp_path))
    band = {(r.row, r.col): r.vs30 for r in tiles.read_tiles(spark, str(tmp_path / "out" / "geology_mvn")).collect()}
    for r in out.collect():
        assert (r.geology_mvn_vs30 is None) == ((r.row, r.col) not in band) and (r.geology_mvn_vs30 is None or band[r.row, r.col] == pytest.approx(r.geology_mvn_vs30, rel=1e-6))
