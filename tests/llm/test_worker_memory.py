"""Python workers outlive operators: what they keep, and how many a task takes."""

import gc

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, common, quality, queries

TEXTS = ["One two  three", None, "", "é ß 株式 <|endoftext|> x", " \n\t ", "a" * 3000]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)


def test_encoding_takes_one_worker_for_each_task(spark):
    out = corpus_pipeline.encoding(spark, docs(spark).coalesce(1), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
    path = public_tokenizers.path(queries.RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {(i, tuple(own.encode_ordinary(t or "")), len(own.encode_ordinary(t or "")), True) for i, t in enumerate(TEXTS)}
    assert {(r.doc_id, tuple(r.ids), r.n_tokens, r.round_trip) for r in out.collect()} == want


def test_a_wrong_decoding_is_told():
    texts = pa.array(["ab", None, "", "é"])
    raw = lambda b: np.frombuffer(b, np.uint8)
    assert bpe._gives_back(texts, raw("abé".encode()), np.array([0, 2, 2, 2, 4])).to_pylist() == [True] * 4
    assert bpe._gives_back(texts, raw("axé".encode()), np.array([0, 2, 2, 3, 4])).to_pylist() == [False, True, False, False]
    assert bpe._gives_back(texts.slice(3), raw("é".encode()), np.array([0, 2])).to_pylist() == [True]


def test_a_worker_keeps_the_tables_of_one_operator(spark):
    def held(batches):
        for _ in batches:
            n = sum(type(x).__name__ in ("Words", "Encoder") and type(x).__module__.startswith("tessera.") for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    weights = quality.train([])
    for _ in range(2):
        assert docs(spark).withColumn("s", quality.scored(docs(spark), weights)).filter("s >= 0").count() == len(TEXTS)
        assert corpus_pipeline.encoding(spark, docs(spark), "").filter("round_trip").count() == len(TEXTS)
    assert max(r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()) <= 1


def test_one_task_may_use_two_and_the_next_drops_them(monkeypatch):
    class Task:
        at = 1

        def taskAttemptId(self):
            return Task.at

    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(common.TaskContext, "get", lambda: Task())
    a, b = common.kept("a", list), common.kept("b", list)
    assert common.kept("a", list) is a and common.kept("b", list) is b
    Task.at = 2
    assert common.kept("b", list) is b and list(common._kept) == ["b"]
    Task.at = 3
    common.forget()
    assert not common._kept


def test_batches_of_whole_texts_are_small_in_every_stage(spark):
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, "some words", "en", "s", 10) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set(most, 10_000)
    assert corpus_pipeline.encoding(spark, docs, "").count() == 3 and int(spark.conf.get(most)) == common.ROWS
    spark.conf.set(most, 7)  # a smaller one stays
    corpus_pipeline.encoding(spark, docs, "")
    assert spark.conf.get(most) == "7"
    spark.conf.unset(most)
