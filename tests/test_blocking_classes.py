"""Candidates scored by classes against the plain join of all pairs."""

import pytest

from tessera.operators import blocking
from tessera.plans import link
from tessera.sources import records, testbeds


@pytest.mark.parametrize("name", ["v3", "base", "high_recall"])
def test_classes_give_what_the_join_gives(spark, monkeypatch, name):
    monkeypatch.setattr(blocking, "SHARD", 60)
    monkeypatch.setattr(blocking, "BLOCK", 20)
    raw = testbeds.load(spark, "/root/testdata/sf0.001", testbeds.PARTIES)
    # copies, more than K, whose ids are between the others
    more = raw.selectExpr("entity_id as id", "*").drop("entity_id").selectExpr("explode(sequence(1, if(id like '%7', 30, 2))) as i", "*").selectExpr("concat(id, '-', i) as entity_id", "business_name", "business_address", "country")
    s1, tgt = link.split(records.preprocess(raw.unionByName(more)))
    got = {tuple(r) for r in blocking.candidates(s1, tgt, blocking.PROFILES[name]).collect()}
    monkeypatch.setattr(blocking, "_repeated", lambda records: True)
    want = {tuple(r) for r in blocking.candidates(s1, tgt, blocking.PROFILES[name]).collect()}
    assert got == want and len(got) > 10_000


def test_repeated_ids_are_summed_as_before(spark):
    rows = [("S1-1", "Blue River", None, "FR"), ("S2-1", "Blue Hill", None, "FR"), ("S2-1", "Red River", None, "FR"), ("S2-2", "Blue River", None, "FR")]
    s1, tgt = link.split(records.preprocess(spark.createDataFrame(rows, records.RECORD)))
    got = {r.tgt_id: r.score for r in blocking.candidates(s1, tgt, blocking.PROFILES["base"]).collect()}
    assert set(got) == {"S2-1", "S2-2"} and got["S2-1"] == pytest.approx(2 / (1 + 1.0986123), abs=2e-6)
