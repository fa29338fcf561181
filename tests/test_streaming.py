"""The stream gives what the batch gives."""

import pytest

from geovelo.operators import cpt
from geovelo.plans import fixtures
from geovelo.streaming import soundings


def test_stream_equals_batch(spark, tmp_path):
    rows = fixtures.soundings(spark, "/root/testdata/sf0.001", 1.0, 0.01).where("cpt_id <= 3")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = soundings.velocities(soundings.read(spark, str(tmp_path / "in"), 1))
    job = stream.writeStream.format("memory").queryName("velocities").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = {(r.cpt_id, r.vs_correlation, r.pos): r.vs for r in spark.table("velocities").collect()}
    want = {(r.cpt_id, r.vs_correlation, r.pos): r.vs for r in cpt.profiles(rows, list(soundings.STATELESS)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    with pytest.raises(ValueError):
        soundings.velocities(rows, ("robertson_2009",))
