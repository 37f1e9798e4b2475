"""near_dedup goes through the SimHash operator first."""

import corpus_pipeline
from tessera.llm import nearcopies, simhash


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"x{i}" for i in range(200)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: asked.append(fps.count()) or links(fps, *a))
    found = []
    by_fingerprint = nearcopies.by_fingerprint
    monkeypatch.setattr(nearcopies, "by_fingerprint", lambda *a: found.append(by_fingerprint(*a)) or found[0])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert asked and found[0].count() == 1
