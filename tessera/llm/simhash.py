"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

Fingerprints have 64 bits, cut into three segments of 22, 21 and 21. If two fingerprints differ in at most three bits,
then in at least two of the segments they differ in at most one: three errors can spoil only one segment twice. Each
segment, filled up to 23 bits, is decoded by the perfect binary Golay code, whose codewords lie within distance three of
every word. Words u, v at distance one have decode(u) within distance four of v; within four of a word lie one codeword,
or six if it is at distance three from the nearest. So an index side holds a fingerprint under its nearest codewords for
each pair of segments (3 keys), a probe side under all near ones (3 to 108), equal keys meet, and the exact distance
verifies. Only distinct fingerprints take part, so groups of exact copies cost nothing; links are kept as pairs of
distinct fingerprints, and components spread by stars over them.

Null texts count as empty; a text without words has fingerprint zero, which links like any other. Rows with null ids
take part: they get their component's smallest id that is not null, or null. Repeated rows are returned each. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, apart, fresh

#: Bits of the segments, and where each begins.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 3
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011


def _remainders(words: np.ndarray) -> np.ndarray:
    """Of division by the generator: the syndromes."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _errors() -> np.ndarray:
    """For each syndrome, up to six error patterns of weight 4 or less that lead to codewords; the nearest first."""
    table = np.full((2048, 6), -1, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        syndromes = _remainders(words)
        order = np.argsort(syndromes, kind="stable")
        words, syndromes = words[order], syndromes[order]
        first = np.searchsorted(syndromes, syndromes)
        taken = (table[syndromes] >= 0).sum(1)
        table[syndromes, taken + np.arange(len(words)) - first] = words
    return table


ERRORS = _errors()


def _codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6): indices of the codewords within distance four, the nearest first; -1 for none."""
    errors = ERRORS[_remainders(segment)]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> 11, -1)


def keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and for each which fingerprint it belongs to."""
    near = [_codewords((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    if not probe:
        near = [x[:, :1] for x in near]
    out, owner = [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        left, right = near[a][:, :, None], near[b][:, None, :]
        key = (left << 12 | right) + (pair << 24)
        who, i, j = np.nonzero((left >= 0) & (right >= 0))
        out.append(key[who, i, j])
        owner.append(who)
    return np.concatenate(out), np.concatenate(owner)


#: Shingles that are counted at once: bounded memory for very long texts.
STEP = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Of all shingles in order; of fewer words than `width`, one of all of them; none without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return np.empty(0, "<u8")
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return np.array([hashed(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        total += np.unpackbits(hashes[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(total * 2 > len(hashes)).tolist())


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def with_fingerprint(text: Column, width: int = 3) -> Column:
    """64 bits as a long."""

    @F.arrow_udf(T.LongType())
    def made(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return made(text)


def _keyed(df: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for i in range(0, len(fp), 1000):
                part = fp[i : i + 1000]
                key, owner = keys(part.view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[owner])], names=["key", "fp"])

    return df.mapInArrow(run, "key int, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a < b: all pairs of the distinct longs `fp` that differ in at most `radius` (three or fewer) bits."""
    assert 0 <= radius <= RADIUS
    index = _keyed(fps, False).select("key", F.col("fp").alias("a"))
    probe = _keyed(fps, True).select("key", F.col("fp").alias("b"))
    found = apart(index).join(probe, (index["key"] == probe["key"]) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes that have edges (a, b).

    Edges turn into stars around smaller nodes until nothing changes, in a number of rounds that grows with the
    logarithm of the nodes. Each round is a written table."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: each node hands its larger neighbours to the least node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node hands its smaller neighbours, and itself, to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = scratch.save(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of df, the fingerprint as 16 hexadecimal digits."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.save(df.select(F.col(doc_id).alias("doc_id"), with_fingerprint(F.col(text), width).alias("fp")))
    roots = fingerprint_components(docs, scratch, radius)
    return docs.join(apart(roots), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_components(docs: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """fp, component_id: the smallest doc_id reachable from each fingerprint of docs (doc_id, fp)."""
    groups = scratch.save(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(groups.select("fp"), radius), scratch)
    marked = groups.join(apart(roots), groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = marked.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(apart(least), "root").select("fp", "component_id")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = 3) -> DataFrame:
    """df with one row of each component, that of the smallest id. Rows that agree in all columns stay or go together."""
    scratch = Scratch(df.sparkSession, "simhash")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    docs = scratch.save(df.select(F.col(doc_id).alias("doc_id"), row.alias("h"), with_fingerprint(F.col(text), width).alias("fp")))
    groups = scratch.save(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(groups.select("fp"), radius), scratch)
    marked = groups.join(apart(roots), groups["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # the winner of a component is an aggregate over (id, row's hash), which combines before it is shuffled
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    won_id, won_row = fresh(df, "won_id", "won_row")
    won = docs.join(apart(marked), "fp").groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias(won_id), F.col("o.h").alias(won_row))
    return df.join(apart(won), F.col(doc_id).eqNullSafe(F.col(won_id)) & (row == F.col(won_row)), "left_semi")
