"""Texts become vectors once; bounds leave out no pair."""

import numpy as np

from tessera.operators import blocking, cosine
from tessera.sources.scratch import Scratch


def test_grams_of_a_text_are_those_of_its_words():
    texts = ["", "a", "a b  cd\tefg", "x1 main road x1 main", "é street", "blue river foods 12 a"]
    names = sorted({g for t in texts for w in t.split() for g in cosine.grams(w)})[::2]
    made, plain = cosine.Vectors(names), cosine.Counted({g: k for k, g in enumerate(names)}.get)
    for t in texts:
        assert [x.tolist() for x in made.of(t)] == [x.tolist() for x in plain.of(t)], t
    assert all(cosine.gram(cosine.code(g)) == g for g in names if g.isascii())


def test_bounds_are_no_less_than_cosines(monkeypatch):
    monkeypatch.setattr(cosine, "BOUND", 16)
    rng, idf = np.random.default_rng(1), np.linspace(1, 5, 90)
    lists = [np.unique(rng.integers(0, 90, rng.integers(0, 30))) for _ in range(80)]
    times = [rng.integers(1, 70_000 if k == 3 else 9, len(x)) for k, x in enumerate(lists)]
    block = cosine.Block([len(x) for x in lists], cosine._bytes(np.concatenate(lists)), cosine._bytes(np.concatenate(times)), idf)
    full = np.zeros((80, 90))
    for k, (i, n) in enumerate(zip(lists, times, strict=True)):
        full[k, i] = n * idf[i] / max(1e-9, np.sqrt(((n * idf[i]) ** 2).sum()))
    exact = full @ full.T
    assert (block.bound @ block.bound.T >= exact - cosine.SHORT).all()
    got = {(i, j): s for i, near, score in cosine._best(block, block, np.zeros(80), 5, 0.15, 90) for j, s in zip(near.tolist(), score.tolist(), strict=True)}
    whole = {(i, j): s for i, near, score in cosine._all(block, block, np.zeros(80), 5, 0.15, 90) for j, s in zip(near.tolist(), score.tolist(), strict=True)}
    want = {(i, j) for i in range(80) for j in range(80) if exact[i, j] > 0.15 and exact[i, j] >= np.sort(exact[i])[-5] - 1e-9}
    for found in (got, whole):
        assert want <= found.keys() and all(abs(s - exact[k]) < 1e-9 for k, s in found.items())


def test_each_text_is_packed_once_whatever_blocks_there_are(spark, monkeypatch):
    monkeypatch.setattr(blocking, "COSINES", 4)
    rows = [(f"S{1 + i % 2}-{i}", f"river {'foods ' * (i % 9)}x{i % 5}", "é road" if i % 10 == 9 else "main road", "FR") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:1], "entity_id string, c_name string, c_addr string, country string")
    packed, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, d: ((out := save(self, d)), packed.extend(out.select("ids").collect() if "sizes" in out.columns and "s1_ids" not in out.columns else []))[0])
    out = blocking.tfidf_cosine(df.filter("entity_id like 'S1-%'"), df.filter("entity_id not like 'S1-%'"), top_k=3).collect()
    assert sorted(i for r in packed for i in r.ids) == sorted(r[0] for r in rows) and len(packed) > 8
    assert {r.s1_id for r in out} == {r[0] for r in rows if r[0].startswith("S1")} and max(r["rank"] for r in out) == 3
