"""Where a query comes to see most rows, the forest's ascent does not fetch them one by one."""

import numpy as np

from tessera.llm.neighbours import Forest


class Counting(np.ndarray):
    taken = 0

    def __getitem__(self, at):
        if isinstance(at, np.ndarray):
            Counting.taken += len(at)
        return np.asarray(self)[at]


def test_products_of_rows_seen_by_most_are_made_together():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    forest = Forest(x)
    forest.x = x.view(Counting)
    queries = rng.standard_normal((40, 64))
    found = list(forest.search(queries, 20))
    seen, whole = sum(n for _, n in found), 0
    for q, (rows, n) in zip(queries, found, strict=True):
        best = set(np.argsort(-(x @ q))[:20].tolist())
        assert len(rows) == 20 or n == len(x)
        whole += len(best & set(rows.tolist()))
    assert whole > 0.97 * 20 * len(queries) and seen > 0.5 * len(x) * len(queries)
    assert Counting.taken < seen / 4
