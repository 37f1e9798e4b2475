"""TF-IDF cosines by blocks against brute force, and what is written on the way."""

import math
from collections import Counter

from tessera.operators import blocking, cosine


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(blocking, "COSINES", 7)
    rows = [(f"S{1 + i % 3}-{i}", f"blue river {i % 5} foods", f"{i % 4} main road x{i % 11}", "FR" if i % 7 else "DE") for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id string, c_name string, c_addr string, country string")
    written, save = [], blocking.Scratch.save
    monkeypatch.setattr(blocking.Scratch, "save", lambda self, d: (written.append(d.columns), save(self, d))[1])
    got = {(r.s1_id, r.tgt_id): (r.cosine, r["rank"]) for r in blocking.tfidf_cosine(df.filter("entity_id like 'S1-%'"), df.filter("entity_id not like 'S1-%'"), top_k=5).collect()}
    assert written and not any("g" in c for c in written)  # no row for each gram of a record
    want = {}
    for c in ("FR", "DE"):
        tf = {i: Counter(g for w in f"{n} {a}".split() for g in cosine.grams(w)) for i, n, a, at in rows if at == c}
        df_ = Counter(g for t in tf.values() for g in t)
        vec = {i: {g: n * (math.log((1 + len(tf)) / (1 + df_[g])) + 1) for g, n in t.items() if df_[g] >= 2} for i, t in tf.items()}
        size = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
        for a in (i for i in vec if i.startswith("S1-")):
            dots = [(sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) / size[a] / size[b], b) for b in vec if not b.startswith("S1-")]
            best = sorted((x for x in dots if x[0] > 0.15), key=lambda x: (-round(x[0], 9), x[1]))[:5]
            want |= {(a, b): (round(x, 6), k + 1) for k, (x, b) in enumerate(best)}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
