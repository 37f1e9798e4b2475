"""Blocks of queries against a shard's units: the whole scores, with names and addresses each summed once."""

import numpy as np
import pyarrow as pa

from tessera.operators import blocking


def test_best_units_are_those_of_the_whole_sums_and_texts_are_summed_once(monkeypatch):
    rng, many_units, top_k = np.random.default_rng(3), 900, 4
    pick = lambda n, of: sorted(rng.choice(of, n, replace=False).tolist())
    names, places = [pick(3, 20) for _ in range(12)], [pick(2, 30) for _ in range(60)]
    weights = {int(k): int(w) for k, w in enumerate(rng.integers(1, 6, 130))}
    name, place, many = rng.integers(0, 12, many_units), rng.integers(0, 60, many_units), rng.integers(0, 3, many_units)
    rows = [("x", 0, 0, 0, names[i], np.flatnonzero(name == i).tolist(), many[name == i].tolist()) for i in range(12)]
    rows += [("x", 0, 0, 1, [100 + k for k in places[i]], np.flatnonzero(place == i).tolist(), []) for i in range(60)]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    right = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names="country shard block kind keys units many".split())
    asked = [(f"q{i}", str(i % 6), str(i % 15), names[i % 6], places[i % 15]) for i in range(300)]
    with_weights = lambda keys, at: [weights[at + k] for k in keys]
    left = pa.table({"q_q": [a[0] for a in asked], "q_name": [a[1] for a in asked], "q_place": [a[2] for a in asked], "q_nk": [a[3] for a in asked], "q_nw": [with_weights(a[3], 0) for a in asked], "q_ak": [[100 + k for k in a[4]] for a in asked], "q_aw": [with_weights(a[4], 100) for a in asked]})
    calls, sums = [], blocking._Index.sums
    monkeypatch.setattr(blocking._Index, "sums", lambda self, k, w: calls.append(1) or sums(self, k, w))
    got = blocking._best(top_k)(left, right).to_pylist()
    assert len(calls) == 6 + 15
    for q, _, _, n, a in asked:
        total = [sum(weights[k] for k in set(n) & set(names[name[u]])) + sum(weights[100 + k] for k in set(a) & set(places[place[u]])) for u in range(many_units)]
        order = sorted((-t, u) for u, t in enumerate(total) if t)[: 2 * top_k]
        want = {(u, -t) for t, u in order if sum(many[v] for s, v in order if s < t) < top_k}
        assert {(r["u"], r["s"]) for r in got if r["q"] == q} == want
