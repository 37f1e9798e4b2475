import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import blocking, features, metrics, model, sampling, validate
from tessera.plans import commands, link
from tessera.sources import records

SF = "/root/testdata/sf0.001"
NEW = ["cascade_v2", "cascade_tier2", "sim_token_set", "gram_variants", "mined_pairs", "first_postings", "countries"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{SF}/part.parquet'")
    cursor = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str({k: v for k, v in sorted(zip(names, r, strict=True))}) for r in cursor.fetchall())
    got = sorted(str(dict(sorted(r.asDict().items()))) for r in entry.queries()[name](spark, SF).collect())
    assert got == want and got


def files(tmp_path):
    """Twelve firms in three sources, for training and for tests."""
    made = tmp_path / "data"
    made.mkdir()
    words = ["Blue River Foods", "Green Hill Market", "Red Lake Tools", "Old Oak Bank", "Silver Moon Books", "Iron Gate Steel", "White Sand Travel", "Black Forest Bakery", "Golden Sun Energy", "Quiet Pine Music", "North Star Shipping", "Clear Water Pumps"]
    head, cut = "entity_id\tbusiness_name\tbusiness_address\tcountry\n", ("train", "test")
    for part in cut:
        (made / f"{part}_source1.tsv").write_text(head + "".join(f"S1-{i}\t{w} Ltd\t{i} Main Street 750{i:02}\tFR\n" for i, w in enumerate(words)))
        (made / f"{part}_source2.tsv").write_text(head + "".join(f"S2-{i}\t{w}\t{i} Main St 750{i:02}\tFR\n" for i, w in enumerate(words)))
        (made / f"{part}_source3.tsv").write_text(head + "".join(f"S3-{i}\t{w} {words[i - 1]}\t{i} Side Street 101{i:02}\tFR\n" for i, w in enumerate(words)))
    (made / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i}\n" for i in range(len(words))))
    return str(made)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    data = files(tmp_path)
    assert commands.main(["preprocess", "--data-dir", data, "--cache-dir", f"{tmp_path}/cache"]) == 0
    assert [x.count() for x in records.load_cache(spark, f"{tmp_path}/cache/test", "FR")] == [12, 24]
    os.remove(f"{data}/test_source3.tsv")
    assert records.preprocess_all(spark, data, f"{tmp_path}/again", parts=("test", "none")) == ["test"]
    assert commands.main(["preprocess", "--data-dir", f"{tmp_path}/none", "--cache-dir", f"{tmp_path}/cache2"]) == 1
    small = ["--n-estimators", "2", "--max-depth", "2", "--lr", "0.1"]
    assert commands.main(["train", "--data-dir", data, "--model-dir", f"{tmp_path}/model", *small]) == 0
    model.PipelineModel.load(f"{tmp_path}/model")
    lists = spark.createDataFrame([(f"S1-{i}", f"S2-{i}" if i else "") for i in range(12)], "s1_id string, ids string").repartition(3)
    records.write_one_file(lists, f"{tmp_path}/m.tsv")
    records.write_one_file(lists, f"{tmp_path}/c.tsv", records.CANDIDATES)
    lines = open(f"{tmp_path}/m.tsv").read().splitlines()
    assert lines[:3] == ["source1_entity_id\tmatched_entity_ids", "S1-0\t", "S1-1\tS2-1"] and len(lines) == 13 and not os.path.exists(f"{tmp_path}/m.tsv.parts")
    records.write_one_file(lists.filter("false"), f"{tmp_path}/none.tsv")
    assert open(f"{tmp_path}/none.tsv").read() == "source1_entity_id\tmatched_entity_ids\n"
    (tmp_path / "data" / "test_source3.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n")
    check = ["validate", "-m", f"{tmp_path}/m.tsv", "-c", f"{tmp_path}/c.tsv", "-t", data, "--check-ids"]
    assert commands.main(check) == 0 and "passed" in capsys.readouterr().out
    (tmp_path / "bad.tsv").write_bytes(open(f"{tmp_path}/m.tsv", "rb").read() + b"S1-\xff\tS2-1\n")
    check[2] = f"{tmp_path}/bad.tsv"
    assert commands.main(check) == 1 and "V13" in capsys.readouterr().out
    assert commands.main(["validate", "-m", f"{tmp_path}/nothing", "-t", data]) == 1


def test_the_grid_is_held_against_held_out_queries(spark, tmp_path):
    data = files(tmp_path)
    raw = records.targets(*[records.read_records(spark, f"{data}/train_source{k}.tsv") for k in (1, 2, 3)])
    truth = records.read_match_lists(spark, f"{data}/train_ground_truth.tsv").select("s1_id", F.explode("ids").alias("tgt_id"))
    got = link.tune(raw, truth, blocking.PROFILES["v6"], [{"rounds": 2, "depth": 2}, {"rounds": 1, "depth": 1, "columns_share": 0.5, "least": 2}], [40, 60])
    assert len(got) == 2 and got[0]["macro_f05"] >= got[1]["macro_f05"] and all(r["threshold"] in (0.4, 0.6) and 0 <= r["macro_f05"] <= 1 for r in got)
    assert link.learner(blocking.PROFILES["v6"])["rounds"] == 850 and all(link.learner(p) for p in blocking.PROFILES.values())


def test_samples(spark):
    rows = [("S1-1", "Blue River Foods", "1 Main Rd 75002", "FR"), ("S2-1", "Blue River Foods", "1 Main Rd 75002", "FR"), ("S3-1", "Blue River Group", None, "FR"), ("S2-2", "zzz", None, "FR"), ("S1-2", "qqq", None, "FR")]
    s1, tgt = link.split(records.preprocess(spark.createDataFrame(rows, records.RECORD)))
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "s1_id string, tgt_id string")
    found = spark.createDataFrame([("S1-1", "S2-2", 1), ("S1-1", "S3-1", 2), ("S1-1", "S2-1", 3)], "s1_id string, tgt_id string, rank int")
    pairs = lambda df, *more: {tuple(r) for r in df.select("s1_id", "tgt_id", *more).collect()}
    # the far pair neither counts as the first negative nor stays as a true one
    assert pairs(sampling.mined(found, truth, s1, tgt, 1), "label") == {("S1-1", "S2-1", 1.0), ("S1-1", "S3-1", 0.0)}
    both = sampling.positives_and_random(truth, s1, tgt, positives=1)
    assert both.filter("label = 1").count() == 1 and both.filter("label = 0").join(truth, ["s1_id", "tgt_id"]).count() == 0
    hard = sampling.all_hard_negatives(s1, tgt, truth)
    assert pairs(hard, "kind") == {("S1-1", "S3-1", "token")} and sampling.all_hard_negatives(s1, tgt, truth, total=0).count() == 0
    r = metrics.capture_report(found, truth).first()
    assert (r.n_true, r.n_captured, r.recall_ceiling) == (2, 1, 50.0)


def test_lines_that_are_no_text(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",)], "s1_id string")
    for name, kind in (("m", records.MATCHES), ("c", records.CANDIDATES)):
        (tmp_path / name).write_bytes("\t".join(kind).encode() + b"\nS1-1\tS2-\xc3\xa9\n")
    told = validate.validate_files(spark, f"{tmp_path}/m", f"{tmp_path}/c", required)[1]
    assert "V13" not in {r.rule for r in told.collect()}
    assert features.VECTORS["p4"] == features.P4
