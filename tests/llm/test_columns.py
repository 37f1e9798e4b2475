"""Operators and stages on tables whose extra columns are called like their own working columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import chat, decontaminate, lines, nearcopies, neighbours, pages, quality, queries, simhash, suffixes, tokens
from tessera.llm.bpe import Bpe

NAMES = ["won_id", "won_row", "_won_id", "leak_id", "leak_hash", "_leak_id", "_leak_hash", "repeat_id", "repeat_h", "elsewhere", "again", "done", "found", "r1", "r2", "d", "h", "g", "s", "t", "i", "fp", "root", "node", "key", "set", "item_id", "similarity", "window", "score", "first", "n_tokens", "_spans", "_gone_units"]
WORDS = " ".join(f"word{i}" for i in range(60))


def table(spark, extra=NAMES):
    texts = [(1, f"{WORDS}. one"), (2, f"other {WORDS}. two"), (3, None), (4, ""), (None, "short"), (2, f"other {WORDS}. two"), (5, "x " * 5000)]
    return spark.createDataFrame([(i, t, *["?"] * len(extra)) for i, t in texts], "doc_id long, text string" + "".join(f", `{c}` string" for c in extra))


def items(spark):
    return spark.createDataFrame([(1, "nothing of this is anywhere in the table of texts at all")], "item_id long, text string")


@pytest.mark.parametrize("name", ["simhash", "nearcopies", "leaks", "lines", "suffixes", "bpe"])
def test_extra_columns_stay(spark, name):
    df = table(spark)
    run = {
        "simhash": simhash.keep_one,
        "nearcopies": nearcopies.keep_one,
        "leaks": lambda x: decontaminate.clean(x, items(spark)),
        "lines": lines.dedup,
        "suffixes": suffixes.remove,
        "bpe": lambda x: Bpe(spark, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).encode(x),
    }[name]
    out, plain = run(df), run(table(spark, []))
    assert out.columns[: len(df.columns)] == df.columns
    assert all(r[c] == "?" for r in out.collect() for c in NAMES)
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_the_other_operators_read_their_columns_only(spark):
    df = table(spark)
    bpe = Bpe(spark, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    assert simhash.near_duplicates(df).count() == df.count()
    assert tokens.by_limit(tokens.histogram(df, bpe)).agg({"n_docs": "sum"}).first()[0] == df.count()
    labels = spark.createDataFrame([(1, 1, "?"), (2, 0, "?"), (2, 0, "?")], "doc_id long, quality int, h string")
    assert df.select(quality.scored(df, quality.model(df, labels)).alias("s")).count() == df.count()
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "?"), (2, [0.9, 0.1], "?")], "vec_id long, embedding array<double>, d string")
    assert neighbours.nearest(vectors, vectors, 1).count() == 2
    web = spark.createDataFrame([(1, "<article><p>a text of some words</p></article>", "?")], "page_id long, html string, found string")
    assert pages.extract(web).first().found == "?"
    said = spark.createDataFrame([(1, 0, "user", "x", "?")], "conv_id long, turn long, role string, text string, turns string")
    assert chat.format_chats(said).count() == 1


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    table(spark, []).write.parquet(f"{root}/documents.parquet")
    items(spark).write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, sf, name, stage):
    """Nulls, empty texts, repeated rows and clashing names go through each stage; an empty table gives an empty one."""
    df = table(spark)
    out = stage(spark, df, sf)
    rows = {(r.doc_id, None if name == "encoding" else r.text) for r in out.collect()}
    if name == "encoding":
        assert out.count() == df.count() and out.filter("round_trip").count() == df.count()
    else:
        assert out.columns == df.columns
        kept = {"near_dedup": {1, 3, None, 5}, "quality_filter": {1, 2, 3, 4, 5, None}, "substring_dedup": {1, 2, 3, 4, 5, None}, "decontamination": {1, 2, 3, 4, 5, None}}[name]
        assert {i for i, _ in rows} == kept
    if name == "substring_dedup":
        assert (1, f"{WORDS}. one") in rows and (2, f"other {WORDS}. two") in rows  # the words differ in one, and make one unit
    assert stage(spark, df.limit(0), sf).count() == 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and {r.doc_id for r in got.collect()} == {1, 3, 5, None}
