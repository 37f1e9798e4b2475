"""The pipeline's near-copies against brute force."""

import numpy as np

import corpus_pipeline
from tessera.llm import nearcopies

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOC)


def brute(data, similarity=0.8):
    """Ids of one row of each component."""
    sets = []
    for _, t in data:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and len(a & b) >= similarity * len(a | b) - 1e-12:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return sorted(min((i for (i, _), h in zip(data, group, strict=True) if h == g), key=lambda i: (i is None, i)) for g in set(group))


def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [f"t{i}" for i in range(300)]
    out = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "one three"), (None, "one two")]
    for k in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(6, 150))))
        for c in range(int(rng.integers(1, 5))):
            out.append((10 * k + c, " ".join(base)))
            # each from the last, so that groups are chains; some changes are too many
            for place in rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 30))):
                base[place] = f"new{rng.integers(1000)}"
    common = " ".join(f"license{i}" for i in range(30))
    return out + [(500 + i, f"{common} {' '.join(rng.choice(vocabulary, 40))}") for i in range(30)]


def test_pipeline_drops_all_near_copies(spark):
    data = corpus()
    want = brute(data)
    assert 60 < len(want) < len(data) - 20
    got = corpus_pipeline.near_dedup(spark, docs(spark, data), "")
    assert sorted(r.doc_id for r in got.collect()) == want and got.columns == docs(spark, []).columns
    assert corpus_pipeline.near_dedup(spark, docs(spark, []), "").count() == 0


def test_order_of_shingles_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "FREQUENT", 3)
    data = corpus()
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs(spark, data)).collect()) == brute(data)


def test_edits_of_one_text_are_not_held_against_each_other(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    data = [(0, " ".join(base))]
    for k in range(1, 161):
        words = list(base)
        # some are near copies of the base, most of the others of nothing
        for place in rng.choice(150, int(rng.integers(1, 6)), replace=False):
            words[place] = f"e{k}x{place}" if k % 8 else f"e{k // 16}x{place}"
        data.append((k, " ".join(words)))
    asked = []
    alike = nearcopies._alike
    monkeypatch.setattr(nearcopies, "_alike", lambda pairs, *a: asked.append(pairs.count()) or alike(pairs, *a))
    want = brute(data)
    assert 40 < len(want) < 140
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs(spark, data)).collect()) == want
    assert sum(asked) < 5 * len(data)
