"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from geovelo.plans import api, fixtures, pipeline
from geovelo.plans.queries import QUERIES
from geovelo.sources import sites, soundings

SF = "/root/testdata/sf0.001"


def test_locations_by_index(spark, tmp_path):
    (tmp_path / "ll.csv").write_text("skip me\n-43.5,x,172.6\n-41.0,y,173.0\n")
    rows = sites.locations(spark, str(tmp_path / "ll.csv"), lon=2, lat=0, skip_rows=1).orderBy("longitude").collect()
    assert [(r.longitude, r.latitude) for r in rows] == [(172.6, -43.5), (173.0, -41.0)]
    assert rows[1].easting == pytest.approx(1_600_000, abs=1e-3)


def test_site_sources_and_union(spark, tmp_path):
    (tmp_path / "a.ll").write_text('# comment\n"Station", "Lon" , "Lat", "Vs30", "Q"\n"014A"   ,  176.87,  -39.49 ,  150   ,  "Q2"  ,  "E"\n"ABC"   ,  176.89,  -39.48 ,  1000  ,  "Q3"  ,  "B"\n"LONG"  ,  176.8,  -39.4 ,  300  ,  "Q3"  ,  "B"\n')
    (tmp_path / "b.csv").write_text("ID\tSite\tLat\tLong\tVs30\n1\tClub\t-43.48\t172.53\t434.8\n")
    (tmp_path / "c.ssv").write_text("e n v\n1500000 5100000 300\n1500000 5100001 NA\n")
    graded = sites.graded_sites(spark, str(tmp_path / "a.ll"))
    assert {r.station: (r.q, r.uncertainty) for r in graded.collect()} == {"014A": (2, 0.2), "ABC": (3, 0.5), "LONG": (3, 0.5)}
    assert {r.station for r in sites.reliable(graded).collect()} == {"014A", "ABC"}
    tabbed, plain = sites.tabbed_sites(spark, str(tmp_path / "b.csv")), sites.cpt_sites(spark, str(tmp_path / "c.ssv"))
    assert tabbed.count() == 1 and plain.count() == 1
    assert sites.union(sites.reliable(graded), tabbed, plain).count() == 4


def test_sounding_files_and_json(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Depth,Qc,Fs,u\n0.02,1000,20,1\n0.04,2000,30,2\n")
    rows = soundings.read_cpt(spark, str(tmp_path / "one.csv"), kpa=True)
    assert [(r.name, r.pos, r.qc) for r in rows.orderBy("pos").collect()] == [("one", 1, 1.0), ("one", 2, 2.0)]
    back = soundings.cpt_from_json(soundings.cpt_to_json(rows)).orderBy("pos").collect()
    assert [(r.depth, r.fs) for r in back] == [(0.02, 0.02), (0.04, 0.03)]
    (tmp_path / "bad.csv").write_text("Depth,Qc,Fs,u\n-0.02,1,0.02,0\n")
    with pytest.raises(Exception, match="negative"):
        soundings.read_cpt(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "hole.csv").write_text("Depth,NValue\n1,10\n2,20\n")
    hole = soundings.read_spt(spark, str(tmp_path / "hole.csv"), soil="Sand")
    assert {(r.soil, r.hammer) for r in hole.collect()} == {("Sand", "Auto")}
    again = soundings.spt_from_json(soundings.spt_to_json(api.create_spt(hole))).orderBy("pos").collect()
    assert [r.n for r in again] == [10.0, 20.0] and again[0].n60 == pytest.approx(10 * 0.8 * 1.05 * 0.75)
    (tmp_path / "vs.csv").write_text("Depth,Vs,Vs_SD\n1,150,0.1\n2,200,0.2\n")
    prof = soundings.read_profile(spark, str(tmp_path / "vs.csv"), layered=True).withColumns({"vs_correlation": F.lit(None).cast("string"), "vs30_correlation": F.lit("boore_2004")})
    told = soundings.profile_from_json(soundings.profile_to_json(prof)).orderBy("pos").collect()
    assert [(r.vs, r.layered, r.vs_correlation) for r in told] == [(150.0, True, None), (200.0, True, None)]
    soundings.write_profiles(prof, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_files_of_one_name_stay_apart_and_keep_their_order(spark, tmp_path):
    for folder, depths in (("a", (0.04, 0.02)), ("b", (1.0, 2.0))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "one.csv").write_text("Depth,Qc,Fs,u\n" + "".join(f"{d},1,0.02,0\n" for d in depths))
    rows = soundings.read_cpt(spark, str(tmp_path / "*" / "one.csv"))
    got = {}
    for r in rows.orderBy("cpt_id", "pos").collect():
        got.setdefault((r.name, r.cpt_id), []).append((r.pos, r.depth))
    assert len(got) == 2 and sorted(got.values()) == [[(1, 0.04), (2, 0.02)], [(1, 1.0), (2, 2.0)]]


@pytest.mark.parametrize("name", ["api_profile_midpoints", "profile_json", "cpt_json", "spt_json"])
def test_dealt_rows_are_not_shuffled_again(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_profiles_of_one_label_stay_apart(spark):
    rows = [("a", "b_c", 1, 1.0, 100.0), ("a", "b_c", 2, 2.0, 200.0), ("a_b", "c", 1, 1.0, 300.0), ("a_b", "c", 2, 2.0, 400.0)]
    cut = spark.createDataFrame(rows, "name string, vs_correlation string, pos int, depth double, vs double").withColumn("vs_sd", F.lit(None).cast("double"))
    got = sorted((r.label, r.vs, r.point, r.depth) for r in api.profile_midpoints(cut, "name").collect())
    assert got == [("a_b_c", vs, point, depth) for first in (100.0, 300.0) for vs, point, depth in ((first, 0, 0.0), (first, 1, 1.5), (first + 100, 2, 1.5), (first + 100, 3, 2.0))]


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    sites.write_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "NA" in text
    with pytest.raises(Exception, match="(?i)exists"):
        sites.write_csv(rows, str(tmp_path / "csv"))
    pixels = spark.range(1000).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.lit(1.0).alias("value"))
    sites.write_raster(pixels, str(tmp_path / "raster"), rows_a_band=25)
    part = sites.read_raster(spark, str(tmp_path / "raster"), 30, 39, rows_a_band=25)
    assert part.count() == 100


def test_api_end_to_end(spark):
    raw = fixtures.soundings(spark, SF, 1.0, 0.01).where("cpt_id IN (1, 2)")
    cut = pipeline.cpt_profiles(raw, ["mcgann_2015", "robertson_2009"]).withColumns({"name": F.col("cpt_id").cast("string")})
    lines = api.profile_midpoints(cut, "cpt_id")
    assert lines.where("label = '1_mcgann_2015'").count() > 100 and lines.where("vs_below > vs_above").count() == 0
    weights = spark.createDataFrame([("profile", "1", 0.5), ("profile", "2", 0.5), ("vs", "mcgann_2015", 0.5), ("vs", "robertson_2009", 0.5), ("vs30", "boore_2004", 1.0)], "kind string, key string, weight double")
    one = api.vs30(cut, weights, ("name", "vs_correlation"), ["boore_2004"]).first()
    assert 100 < one.vs30 < 800 and one.vs30_sd > 0
    curve = api.average(cut.withColumn("vs30_correlation", F.lit(None).cast("string")), weights, ("name", "vs_correlation"))
    assert curve.count() > 5000
    assert api.cpt_midpoints(api.create_cpt(raw)).select("measure").distinct().count() == 3
    assert "Auto" in api.hammer_types() and "Clay" in api.soil_types() and len(api.cpt_correlations()) == 7


@pytest.mark.parametrize("broken", [False, True])
def test_entry_without_training_operators(monkeypatch, broken):
    """The query registry does not need the training-data subpackage; but one that is there and breaks is an error."""
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def refuse(name, *a, **k):
        if "llm" in name or name == "corpus_pipeline" or (name == "geovelo" and "llm" in str(a)):
            raise ModuleNotFoundError(name, name="a_missing_library" if broken else name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", refuse)
    try:
        if broken:
            with pytest.raises(ImportError):
                importlib.reload(entry)
        else:
            importlib.reload(entry)
            assert "vsz" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
