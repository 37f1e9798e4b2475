"""The second tier's queries are found without the pairs that postal codes settle."""

from tessera.operators import blocking
from tessera.plans import link
from tessera.sources import records, testbeds
from tests.test_classes import twins


def test_the_first_tier_tells_whom_it_takes(spark):
    s1, tgt = twins(spark, 40)
    sure = blocking._cascade(s1, tgt, taken=True)[0]
    assert {r.a_class for r in sure.collect()} == {r.a_class for r in blocking._cascade(s1, tgt)[0].select("a_class").collect()}
    assert sure.columns == ["a_class"] and blocking.second_tier(s1, tgt).count() == 0


def test_taken_queries_are_those_of_the_whole_cascade(spark):
    s1, tgt = link.split(records.preprocess(testbeds.load(spark, "/root/testdata/sf0.001", testbeds.PARTIES)))
    taken = {r.s1_id for r in blocking.cascade(s1, tgt).select("s1_id").distinct().collect()}
    want = {tuple(r) for r in blocking.candidates(s1, tgt, blocking.PROFILES["v2"]).collect() if r.s1_id not in taken}
    assert {tuple(r) for r in blocking.second_tier(s1, tgt).collect()} == want
