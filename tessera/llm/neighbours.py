"""Approximate nearest neighbours by inner product, with a forest of hash prefixes.

A tree hashes each vector by random hyperplanes to a string of 32 bits and keeps the strings as a sorted array. A query
descends in all trees to its longest prefix matches and then ascends in all of them at once, a bit at a time: at each
length its candidates are those that share so long a prefix in some tree, a run of each sorted array. Vectors are put on
a sphere by one more dimension, so that the largest inner product is the smallest angle. Two at angle t share a prefix of
x bits in one of L trees with probability 1 - (1 - (1 - t/pi)^x)^L; the ascent ends when this is `SURE` or more for the
angle of the worst result so far, or at the root, where all have been seen. So no number of candidates is set: close
neighbours end it early, and data without any make it look at most rows.

Rows and queries meet in blocks of bounded size, each with its own forest; so every query visits every block, in which
it sees few rows if it has close neighbours there and most if none. Rows that tie with the last of the nearest are all
kept until the ids decide. Equal vectors are one row with the smallest of their ids, as many as
can be wanted. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with null
ids; only vectors of one length meet. Repeated rows (an id and a vector) count once. Ties go to smaller ids. An empty
table, or one without queries, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

TREES = 24
BITS = 32
SURE = 0.97
#: Rows of a block of the index, and of one of queries, at most (on average); and queries that are searched together.
ROWS, QUERIES, TOGETHER = 16384, 8192, 512
#: Where a query comes to see one row in so many at once, the products of the block and all queries searched with it are
#: made together; which rows count is the ascent's to say.
MANY = 8
#: What rounding may do to a product, as a share of the largest there can be.
SLACK = 1e-12


class Forest:
    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x, norm = x, np.sqrt((x * x).sum(1))
        self.most = norm.max()
        self.planes = np.random.default_rng(seed).standard_normal((TREES, x.shape[1] + 1, BITS))
        filled = np.concatenate([x, np.sqrt(np.maximum(0, self.most**2 - norm**2))[:, None]], axis=1)
        codes = self._codes(filled)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, 1)

    def _codes(self, filled: np.ndarray) -> np.ndarray:
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1)
        return np.stack([(filled @ p > 0) @ weights for p in self.planes])

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int]]:
        """For each query the rows of the k best found, all of those that tie with the last, in no order; and how many
        rows were looked at."""
        for i in range(0, len(queries), TOGETHER):
            yield from self._search(queries[i : i + TOGETHER], k)

    def _search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int]]:
        codes = self._codes(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1))
        # where the run of each prefix begins and ends, by tree, length and query
        low, high = np.empty((TREES, BITS + 1, len(queries)), np.int64), np.empty((TREES, BITS + 1, len(queries)), np.int64)
        for t in range(TREES):
            for x in range(BITS + 1):
                first = codes[t] >> (BITS - x) << (BITS - x)
                low[t, x] = np.searchsorted(self.codes[t], first)
                high[t, x] = np.searchsorted(self.codes[t], first + (np.int64(1) << (BITS - x)))
        low, high = (np.ascontiguousarray(ends.transpose(2, 1, 0)) for ends in (low, high))
        total = (high - low).sum(2)
        norms = np.sqrt((queries * queries).sum(1))
        products = None
        for i, q in enumerate(queries):
            seen = np.zeros(len(self.x), bool)
            rows, scores, worst = np.empty(0, np.int64), np.empty(0), -np.inf
            deepest = np.flatnonzero(total[i] >= k)
            x = int(deepest[-1]) if len(deepest) else 0
            slack = SLACK * norms[i] * self.most * len(q)
            # the part of each tree's run that has been met
            begun = ended = low[i, x]
            share = 0.0
            while True:
                now = seen
                if x == 0:
                    now = np.ones(len(self.x), bool)
                else:
                    start, end = low[i, x], high[i, x]
                    grown = np.flatnonzero((start < begun) | (ended < end))
                    if len(grown):
                        now = seen.copy()
                        for t, a, b, c, d in zip(grown.tolist(), start[grown].tolist(), begun[grown].tolist(), ended[grown].tolist(), end[grown].tolist(), strict=True):
                            if a < b:
                                now[self.order[t, a:b]] = True
                            if c < d:
                                now[self.order[t, c:d]] = True
                    begun, ended = start, end
                if now is not seen:
                    fresh = np.flatnonzero(now ^ seen)
                    seen = now
                    if len(fresh) * MANY > len(self.x) and products is None:
                        products = queries @ self.x.T
                    near = self.x[fresh] @ q if products is None else products[i, fresh]
                    if len(rows) >= k:
                        # what is under the worst of them changes nothing
                        better = near >= worst - slack
                        fresh, near = fresh[better], near[better]
                    rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, near])
                    if len(rows) > k:
                        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                        best = scores >= worst - slack
                        rows, scores = rows[best], scores[best]
                    elif len(rows) == k:
                        worst = scores.min()
                    if len(rows) >= k:
                        share = 1 - np.arccos(min(max(worst / (norms[i] * self.most), -1), 1)) / np.pi
                if x == 0 or len(rows) >= k and 1 - (1 - share**x) ** TREES >= SURE:
                    break
                x -= 1
            yield rows, int(seen.sum())


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of df nearest to each row of queries, but for the query's own."""
    scratch = Scratch(df.sparkSession, "forest")

    def vectors(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        # -0.0 and 0.0 are equal vectors
        return rows.filter(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).dropDuplicates(["id", "v"])

    first = Window.partitionBy("v").orderBy("id")
    # of equal vectors as many ids as can be wanted, and one more for the query's own; Spark cuts groups before it shuffles
    ids = vectors(df).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    index = scratch.save(ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = scratch.save(vectors(queries))
    n, m = index.count(), asked.count()
    down, over = -(-n // ROWS) or 1, -(-m // QUERIES) or 1
    grid = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = index.select(F.size("v").alias("d"), F.pmod(F.xxhash64("v"), F.lit(down)).cast("int").alias("i"), grid(over).alias("j"), "v", "ids")
    wanted = asked.select(F.size("v").alias("d"), grid(down).alias("i"), F.pmod(F.xxhash64("id", "v"), F.lit(over)).cast("int").alias("j"), "id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            matrix = lambda c: np.array(c.combine_chunks().flatten() if isinstance(c, pa.ChunkedArray) else c.flatten()).reshape(len(c), -1)
            x, q = matrix(left["v"]), matrix(right["v"])
            own, ids = right["id"].to_pylist(), left["ids"].to_pylist()
            for a, v, (found, _) in zip(own, q, Forest(x).search(q, min(k + 1, len(x))), strict=True):
                # the products that are returned are all made one way, and no zero has a sign
                scores = (x[found] * v).sum(1) + 0.0
                pairs = sorted((-s, b) for s, r in zip(scores.tolist(), found.tolist(), strict=True) for b in ids[r] if b != a)[:k]
                out += [(a, b, -s) for s, b in pairs]
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ["d", "i", "j"]
    found = rows.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    # an id may stand for several vectors; its best counts
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
