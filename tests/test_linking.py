import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import similarity, text
from tessera.operators import blocking, decide, features, metrics, model, sampling, validate
from tessera.plans import link
from tessera.sources import records
from tessera.streaming import arrivals

SF = "/root/testdata/sf0.001"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


NAMES = {
    "Maure Williams Colombier Inc": "maure williams colombier", "maurewilliamscolombier.com": "maurewilliamscolombier", "AT&T Services, LLC": "at and t services", "Société Générale S.A.R.L.": "societe generale s a r l",
    "Tata Consultancy Services Pvt. Ltd.": "tata consultancy services", "https://www.foo.co.in/about": "foo", "Toys R.Us": "toys r", "The Company Ltd": "the", "Company Ltd": "company ltd", "NaN": "", None: "", "": "",
    "株式会社": "", "Straße Øst": "strae st", "Domino's": "domino s", "Domino’s": "dominos", "Café Noir": "cafe noir", "Foo™": "footm",
}
ADDRESSES = {
    "85 Wayne Avenue, Ticonderoga, NY": "85 wayne avenue ticonderoga ny", "Wayne Ave, Ticonderoga Townshiip, New York": "wayne avenue ticonderoga townshiip new york",
    "Near SBI ATM, Sector 14, Gurgaon, 122001": "near sbi atm sector 14 gurgaon 122001", "Apt #4-B/12, St Louis Rd": "apartment number 4 b 12 street louis road", None: "",
}


def test_golden_text(spark):
    assert column(spark, NAMES, text.clean_name) == list(NAMES.values())
    assert column(spark, ADDRESSES, text.clean_address) == list(ADDRESSES.values())
    assert column(spark, ["AT&T Services, LLC"], lambda c: text.clean_name(c, text.LEGAL_WIDE, text.TLD_WIDE)) == ["at and t"]
    assert column(spark, ["near 14 14 122001 12b"], text.numbers) == [["14", "122001"]] and column(spark, ["near 14 122001"], text.postals) == [["122001"]]
    assert column(spark, ["ﬁ²ﬂ", "ｘ", None], text.fold_all) == ["fi2fl", "x", None] and column(spark, ["ﬁ²™é"], text.fold) == ["fi2TMe"]
    assert column(spark, ["ab", "abcd", ""], text.char_ngrams) == [[], ["abc", "bcd"], []] and column(spark, ["ab"], lambda c: text.char_ngrams(c, short="whole")) == [["ab"]]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_kernels():
    words = ["maure williams colombier", "maure wilblims colombier", "abc", "xyz", "", "williams colombier maure", "a b c", "colombier", "new york mets vs atlanta braves", "mets", "école", "aaaaabbbb"]
    for a in words:
        for b in words:
            assert similarity._lcs(a, b) == brute_lcs(a, b)
            assert similarity.partial_ratio(a, b) == pytest.approx(similarity.partial_ratio(b, a))
            if a and b:
                short, long = sorted((a, b), key=len)
                best = max(similarity.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))
                assert similarity.partial_ratio(a, b) >= best - 1e-9
    assert similarity.ratio("maure williams colombier", "maure wilblims colombier") == pytest.approx(95.8333, abs=1e-4)
    assert similarity.ratio("williams", "wilblims") == 87.5 and similarity.ratio("abc", "xyz") == 0 and similarity.ratio("", "") == 100
    assert similarity.token_sort_ratio("b a", "a b") == 100 and similarity.token_set_ratio("a b", "a b c") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and similarity.jaro_winkler("dwayne", "duane") == pytest.approx(0.84)
    assert similarity.weighted_ratio("", "a") == 0 and similarity.weighted_ratio("abc def", "def abc") == 95


@pytest.mark.parametrize(("truth", "predicted", "want"), [([1, 2], [1, 3, 2], 0.7142857), ([1, 2, 3], [1], 0.7142857), ([], [], 1.0), ([], [1], 0.0), ([1], [], 0.0), ([1], [2], 0.0)])
def test_f05(spark, truth, predicted, want):
    long = lambda ids: spark.createDataFrame([(1, i) for i in ids], "s1_id int, tgt_id int")
    out = metrics.macro_f05(spark.createDataFrame([(1,)], "s1_id int"), long(truth), long(predicted)).first()
    assert out.macro_f05 == pytest.approx(want, abs=1e-6)


def party(spark):
    rows = [
        ("S1-1", "Blue River Foods Ltd", "12 Main St, 75002 Paris", "FR"), ("S2-1", "Blue Rivr Foods", "12 Main Street 75002", "FR"), ("S3-1", "blueriverfoods.com", None, "FR"), ("S3-2", "Blue River Foods", "99 Other Rd, 10115", "FR"),
        ("S1-2", "Green Hill Market", "5 Oak Ave", "US"), ("S2-2", "Green Hill Market Inc", "5 Oak Avenue", "US"), ("S1-3", None, None, "US"), ("S2-3", "Blue River Foods", None, "US"),
    ]
    return spark.createDataFrame(rows, records.RECORD)


def test_linking_end_to_end(spark, tmp_path):
    raw = party(spark)
    lists = {r.s1_id: r.ids for r in link.resolve_by_rule(raw, blocking.PROFILES["v6"], 0.9).collect()}
    assert lists == {"S1-1": "S2-1,S3-2,S3-1", "S1-2": "S2-2", "S1-3": ""}
    s1, tgt = link.split(records.preprocess(raw))
    cascade = {(r.s1_id, r.tgt_id): r.score for r in blocking.cascade(s1, tgt).collect()}
    assert cascade == {("S1-1", "S3-1"): 0.98, ("S1-2", "S2-2"): 1.0}
    pairs = features.pairs(spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-1", "S3-1"), ("S1-3", "S2-2")], "s1_id string, tgt_id string"), s1, tgt)
    for kind, width in (("p1", 17), ("p2", 28), ("p4", 37)):
        assert len(features.VECTORS[kind]) == width and features.features(pairs, kind).count() == 4
    assert features.features(pairs, "p3").count() == 3  # the one with an empty name is far apart
    got = {(r.s1_id, r.tgt_id): r for r in features.features(pairs, "p4").collect()}
    r = got["S1-1", "S3-2"]
    assert (r.name_exact_match, r.addr_is_missing, r.num_mismatch_penalty, r.pin_mismatch_penalty, r.pin_both_present, r.is_s3) == (1, 0, -1, 1, 1, 1)
    assert got["S1-1", "S3-1"].addr_is_missing == 1 and got["S1-1", "S3-1"].compact_exact == 1 and got["S1-1", "S2-1"].num_common_count == 2
    assert decide.guarded(pairs, F.lit(80)).filter("tgt_id = 'S3-2'").count() == 0 and decide.guarded(pairs, F.lit(95)).count() == 4
    out = spark.createDataFrame(list(lists.items()), "s1_id string, ids string")
    records.write_match_lists(out, f"{tmp_path}/m")
    assert {r.s1_id: r.ids for r in records.read_match_lists(spark, f"{tmp_path}/m").collect()} == {k: [x for x in v.split(",") if x] for k, v in lists.items()}
    records.write_match_lists(out, f"{tmp_path}/c", records.CANDIDATES)
    required = s1.select(F.col("entity_id").alias("s1_id"))
    assert validate.validate_files(spark, f"{tmp_path}/m", f"{tmp_path}/c", required)[0] == 0
    assert validate.validate_files(spark, f"{tmp_path}/none", f"{tmp_path}/c", required)[0] == 1
    records.write_cache(records.preprocess(raw), f"{tmp_path}/cache")
    a, b = records.load_cache(spark, f"{tmp_path}/cache", "US")
    assert (a.count(), b.count()) == (2, 2)


def test_headers():
    assert validate.header_problem(None) == validate.header_problem(" ") == "V1" and validate.header_problem("a,b") == "V2" and validate.header_problem("a\tb") == "V3"
    assert validate.header_problem("SOURCE1_ENTITY_ID\tMatched_Entity_Ids\n") is None


def test_tsv(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-2\t"a ""b"" c"\tNA\tX\nS1-1\tnull\tx\t\n', encoding="utf-8")
    got = records.read_records(spark, str(tmp_path / "r.tsv")).collect()
    assert [tuple(r) for r in got] == [("S1-2", 'a "b" c', None, "X"), ("S1-1", None, "x", None)]
    assert [r.entity_id for r in records.read_records(spark, str(tmp_path / "r.tsv"), 1).collect()] == ["S1-1"]


def test_model(spark, tmp_path):
    rows = [(f"S1-{i}", float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(80)]
    df = sampling.group_split(spark.createDataFrame(rows, "s1_id string, x double, y double, label double"), F.col("s1_id"))
    first = model.load_or_train(f"{tmp_path}/m", lambda: model.train(df, ["x", "y"], rounds=3, depth=2, validation="is_validation"))
    again = model.load_or_train(f"{tmp_path}/m", lambda: 1 / 0)
    p = model.blend(first, again, df).select("label", "probability_1").collect()
    assert min(r.probability_1 for r in p if r.label) > max(r.probability_1 for r in p if not r.label)


def test_stream(spark, tmp_path):
    raw = party(spark)
    raw.filter("entity_id like 'S1-%'").write.parquet(f"{tmp_path}/in")
    tgt = records.preprocess(raw.filter("entity_id not like 'S1-%'"))
    arrivals.link_stream(spark.readStream.schema(records.RECORD).parquet(f"{tmp_path}/in"), tgt, blocking.PROFILES["v6"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {(r.s1_id, r.tgt_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()} >= {("S1-1", "S2-1"), ("S1-2", "S2-2")}


CHECKED = ["norm_name", "norm_address", "preprocess_cache", "block_multi_v6", "block_multi_high_recall", "sim_ratio", "features37_parts", "match_lists", "macro_f05", "threshold_sweep", "validate_report"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("part", "pages", "customer", "supplier", "nation", "lineitem", "orders", "documents", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str({k: v for k, v in sorted(zip(names, r, strict=True))}) for r in cursor.fetchall())
    got = sorted(str(dict(sorted(r.asDict().items()))) for r in entry.queries()[name](spark, SF).collect())
    assert got == want and got


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kernels_of_many_pairs_are_those_of_each():
    import random

    rng = random.Random(4)
    words = ["alpha", "beta", "gam", "delta co", "x", "blue river", "steel", "small plated", "é学", "a b", "anodized copper"]
    said = lambda: " ".join(rng.choices(words, k=rng.randrange(7)))
    pairs = [(said(), said()) for _ in range(400)] + [("", ""), ("a", ""), ("", "b"), ("aaaa", "aaaa"), (" ", " a"), ("x" * 70 + "y", "y" + "x" * 70), ("ab" * 32, "ba" * 32), ("ab" * 40, "ba" * 39)]
    pairs += [(a, a.replace("a", "e")) for a, _ in pairs[:100]]
    got = similarity.all_kernels(list(similarity.KERNELS), pairs)
    for name, one in similarity.KERNELS.items():
        assert got[name].tolist() == [one(a, b) for a, b in pairs]


def test_group_split_keeps_keys_together(spark):
    df = spark.createDataFrame([(i % 200, i) for i in range(1000)] + [(None, 1), (None, 2)], "k long, v long")
    out = sampling.group_split(df, F.col("k"))
    assert out.groupBy("k").agg(F.countDistinct("is_validation").alias("n")).filter("n > 1").count() == 0
    assert 0.15 < out.filter("is_validation").count() / out.count() < 0.35 and out.filter("is_validation is null").count() == 0


def test_fold_spells_signs_of_more_letters(spark):
    signs = ["Dĳkstra", "‼", "ǉ", "①", "Ⅷ", "㎏", "𝐀cme", "½", "…", "Ørsted", None]
    want = [None if x is None else text._ascii(x) for x in signs]
    assert column(spark, signs, text.fold) == column(spark, signs, text.fold_all) == want and want[:7] == ["Dijkstra", "!!", "lj", "1", "VIII", "kg", "Acme"]
    assert column(spark, ["\n\t https://www.foo.com"], text.clean_name) == ["foo"]


def test_a_repeated_header_is_reported(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",)], "s1_id string")
    for name, kind in (("m", records.MATCHES), ("c", records.CANDIDATES)):
        head = "\t".join(kind)
        (tmp_path / name).write_text(f"{head}\nS1-1\tS2-1\n" + (f"{head}\n" if name == "m" else ""))
    code, told = validate.validate_files(spark, f"{tmp_path}/m", f"{tmp_path}/c", required)
    assert code == 1 and {r.rule for r in told.collect()} >= {"V11"}
    (tmp_path / "m").write_text("\t".join(records.MATCHES) + "\nS1-1\tS2-1\n")
    assert validate.validate_files(spark, f"{tmp_path}/m", f"{tmp_path}/c", required)[0] == 0
    assert validate.validate_files(spark, f"{tmp_path}/none", f"{tmp_path}/c", required) == (1, None)


def test_long_texts_are_folded_in_time_of_their_length(spark):
    # every sign used to be held against hundreds of single ones
    once = "plain words, café, ﬁn… 株式 ½ 𝐀 " + "and so on " * 30
    want = "plain words, cafe, fin...  12 A " + "and so on " * 30
    column(spark, [once], text.fold)
    began = time.monotonic()
    assert column(spark, [once * 6000, "plain " * 300_000], text.fold) == [want * 6000, "plain " * 300_000]
    assert time.monotonic() - began < 10
