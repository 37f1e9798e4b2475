import pytest

import __spark_entry__ as entry
from tessera.operators import blocking
from tessera.plans import link
from tessera.sources import records

SF = "/root/testdata/sf0.001"


def test_second_tier_has_all_that_the_first_took_nothing_of(spark):
    rows = [
        ("S1-1", "Blue River Foods", "1 Main Rd 10115", "FR"), ("S2-1", "Blue River Foods", "9 Other Rd 75002", "FR"),  # exact, but rejected
        ("S1-2", "Green Hill Market", None, "FR"), ("S3-2", "greenhillmarket.com", None, "FR"),  # taken by its compact name
        ("S1-3", "Red Lake Tools", None, "FR"), ("S2-3", "Red Lake Toolz", None, "FR"),  # met by no tier-1 key
        ("S1-4", "Old Oak Bank", None, "FR"), ("S2-4", "Old Oak Bank", None, "FR"),  # taken by its name
    ]
    s1, tgt = link.split(records.preprocess(spark.createDataFrame(rows, records.RECORD)))
    got = {(r.s1_id, r.tgt_id) for r in blocking.second_tier(s1, tgt).collect()}
    assert {a for a, _ in got} == {"S1-1", "S1-3"} and {("S1-1", "S2-1"), ("S1-3", "S2-3")} <= got


@pytest.mark.parametrize("name", ["gbt_score"])
def test_models_score_all_candidates(spark, name):
    pairs = lambda q: sorted((r.s1_id, r.tgt_id) for r in entry.queries()[q](spark, SF).select("s1_id", "tgt_id").collect())
    assert pairs(name) == pairs("training_pairs")
