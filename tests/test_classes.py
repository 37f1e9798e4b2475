"""Records of equal texts are worked on once, and each gets what its class gets."""

from tessera.operators import blocking, features, model
from tessera.plans import link
from tessera.sources import records
from tessera.sources.scratch import Scratch


def twins(spark, n):
    rows = [(f"S1-{i}", "Blue River Foods", f"{1 + i % 2} Main Rd 10115", "FR") for i in range(n)] + [(f"S2-{i}", "Blue River Foods", "1 Main Rd 10115", "FR") for i in range(n)] + [("S3-0", "blueriverfoods.com", None, "FR")]
    return link.split(records.preprocess(spark.createDataFrame(rows, records.RECORD)))


def test_cascade_scores_a_pair_of_texts_once(spark):
    s1, tgt = twins(spark, 40)
    assert blocking._cascade(s1, tgt)[0].count() == 2  # two texts against one; the compact name has over three hits and no address
    got = [tuple(r) for r in blocking.cascade(s1, tgt).collect()]
    want = {(f"S1-{i}", f"S2-{k}", 0.95) for i in range(40) for k in range(40)}
    assert len(got) == len(want) and set(got) == want


def test_repeated_records_are_repeated(spark):
    s1, tgt = twins(spark, 1)
    assert blocking.cascade(s1.unionByName(s1), tgt).count() == 2 * blocking.cascade(s1, tgt).count()


def test_candidates_and_vectors_of_a_text_are_made_once(spark):
    s1, tgt = twins(spark, 40)
    found = blocking.candidates(s1, tgt, blocking.PROFILES["v6"])
    assert found.count() == 40 * 15 and found.join(found.select("tgt_id"), "tgt_id", "left_semi").groupBy("s1_id").count().select("count").distinct().count() == 1
    rows, vectors = features.by_class(found.select("s1_id", "tgt_id"), s1, tgt, "p4", Scratch(spark, "test"))
    assert vectors.count() == 2 and rows.count() == 40 * 15
    plain = features.features(features.pairs(found.select("s1_id", "tgt_id"), s1, tgt), "p4")
    got = rows.join(vectors, "pair").select("s1_id", "tgt_id", *features.P4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_a_weight_stands_for_rows(spark):
    rows = [(float(i % 10), float(i % 10 > 6)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, label double")
    few = df.groupBy("x", "label").count().selectExpr("x", "label", "cast(count as double) as n")
    asked = few.select("x")
    got, want = ({r.x: r.probability_1 for r in model.predict(model.train(d, ["x"], rounds=3, rows_share=1.0, **w), asked).collect()} for d, w in ((few, {"weight": "n"}), (df, {})))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
