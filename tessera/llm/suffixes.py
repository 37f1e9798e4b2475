"""Removal of long repeated byte strings, exactly, with a logarithmic family of sparse suffix indexes.

Of each string of `MIN_BYTES` bytes one place is chosen by content alone: the start of the least hash among its strings
of `GRAM` bytes, the leftmost of equal ones. Equal strings have it at the same offset, so of all suffixes only those
that start at such anchors need an index, about one in sixty. A batch's suffix array is the sorted run of its anchors'
keys, the hashes of their first `GRAM` bytes. `Family` keeps runs as levels of geometrically growing size: a new run is
merged against each level to find keys met before, then levels of equal size merge.

Anchors whose keys repeat are looked at closer. An anchor stands for the strings around it of which it is the place;
their union is its context. If a context repeats as a whole, all of its strings do. The others are compared string by
string with one representative of each context of the same key, sorted runs at a time. Hashes have 64 bits and are met
under equal keys of 64 bits; no text leaves its document but the contexts of representatives. What passes on to the
closer look is cut by bitmaps of a fixed size, which may let more pass than needed but never less.

Null texts count as empty. Texts shorter than `MIN_BYTES` keep all. Rows that agree in id and text are documents of
their own, each repeating the other. Null ids are ids. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fixed_bitmap, fresh, passing

MIN_BYTES = 200
GRAM = 64
BATCHES = 4
#: Windows of a long text looked at together.
PART = 1 << 20
#: Contexts compared together, if their keys end there.
ROWS = 4000

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


class Hashes:
    """Of all substrings of some bytes: sums of the bytes' values by falling powers, moved to begin at power 0."""

    def __init__(self, data: np.ndarray):
        self.up, down = _Powers.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * down[:-1], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.up[: len(self.sums) - width])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width`."""
    n, size, out = len(v) - width + 1, 1, v
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, first, last, key, context: each anchor, the strings' starts that it stands for, its key and the hash of
    its context."""
    hashes = Hashes(data)
    keys = hashes.all(GRAM)
    low = np.uint64((1 << 22) - 1)
    # the place below the hash: the least is the leftmost of equal ones
    chosen = (_least((keys & ~low) | np.arange(len(keys), dtype=np.uint64), MIN_BYTES - GRAM + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
    at = chosen[first]
    context = _mixed(hashes.of(first, last + MIN_BYTES) + (at - first).astype(np.uint64) * np.uint64(_MULTIPLIER) + (last - first).astype(np.uint64))
    return at, first, last, keys[at], context


def _of_text(text: bytes) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """Parts of a text: where each begins, its bytes and anchors. Parts share all but one of a string's bytes."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - MIN_BYTES + 1, PART):
        part = data[start : start + PART + MIN_BYTES - 1]
        if len(part) >= MIN_BYTES:
            yield start, part, anchors(part)


def _identity(r1: int, first: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(first.astype(np.uint64) + np.uint64(1)) ^ np.uint64(r1 & (1 << 64) - 1))


def _passing(bitmap: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    return np.ones(len(keys), bool) if bitmap is None else passing(bitmap, keys)


def _scan(docs: DataFrame, what: str, sent=None) -> DataFrame:
    """keys: batch, g of all anchors. records: those whose key passes the bitmap, without text. contexts: those whose
    identity passes, with the bytes."""
    schema = {"keys": "b int, g long", "records": "r1 long, r2 long, first int, last int, g long, h long, id long", "contexts": "g long, r1 long, r2 long, first int, last int, at int, context binary"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if sent is None else sent.value
        for b in batches:
            out: list[list[np.ndarray]] = []
            held, size = [], 0
            for r1, r2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                for start, part, (at, first, last, g, h) in _of_text(text):
                    who = _identity(r1, first + start)
                    keep = np.flatnonzero(_passing(bitmap, who if what == "contexts" else g))
                    n = len(keep)
                    if what == "keys":
                        out.append([np.full(n, r1 % BATCHES), g])
                    else:
                        row = [np.full(n, r1), np.full(n, r2), first[keep] + start, last[keep] + start]
                        if what == "records":
                            out.append([*row, g[keep].view(np.int64), h[keep].view(np.int64), who[keep].view(np.int64)])
                        else:
                            out.append([g[keep].view(np.int64), *row, at[keep] + start])
                            held += [part[i : j + MIN_BYTES].tobytes() for i, j in zip(first[keep].tolist(), last[keep].tolist(), strict=True)]
                    size += n
                if size > 20_000:
                    yield _batch(schema, out, held)
                    out, held, size = [], [], 0
            if out:
                yield _batch(schema, out, held)

    return docs.mapInArrow(run, schema)


def _batch(schema: str, out: list[list[np.ndarray]], held: list[bytes]) -> pa.RecordBatch:
    names, kinds = zip(*(x.strip().split(" ") for x in schema.split(",")), strict=True)
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64() if k == "long" else pa.int32()) for c, k in zip(columns, kinds, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, *([pa.array(held, pa.binary())] if "binary" in kinds else [])], names=list(names))


class Family:
    """Sorted runs (g, n): keys of suffixes and how often each occurs, as levels that double in size."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels = scratch, {}

    def add(self, run: DataFrame) -> DataFrame:
        """The keys of a new run that it repeats or that some level holds; then the run is a level."""
        found = run.filter("n > 1").select("g")
        for level in self.levels.values():
            found = found.unionByName(run.join(level.select("g"), "g", "left_semi").select("g"))
        found = self.scratch.save(found.distinct())
        size, new = 0, run
        while size in self.levels:
            old = self.levels.pop(size)
            merged = self.scratch.save(old.unionByName(new).groupBy("g").agg(F.sum("n").alias("n")).sortWithinPartitions("g"))
            self.scratch.drop(old)
            self.scratch.drop(new)
            new, size = merged, size + 1
        self.levels[size] = new
        return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (inclusive) of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _strings(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of some contexts: which row, which number in it, and a hash of key, offset and bytes."""
    contexts = rows["context"].combine_chunks()
    data = np.frombuffer(b"".join(contexts.to_pylist()), np.uint8)
    first, last, at = (rows[c].to_numpy().astype(np.int64) for c in ("first", "last", "at"))
    n = last - first + 1
    begin = np.cumsum(n + MIN_BYTES - 1) - (n + MIN_BYTES - 1)
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = begin[row] + number
    offset = (at - first)[row] - number
    g = rows["g"].to_numpy().view(np.uint64)
    hashes = Hashes(data)
    return row, number, _mixed(hashes.of(place, place + MIN_BYTES) + _mixed(g[row] + offset.astype(np.uint64)))


def _repeated(rows: pa.Table) -> pa.RecordBatch:
    """r1, r2, first, last: the strings of whole groups of contexts that repeat among them."""
    row, number, hashed = _strings(rows)
    order, g = np.argsort(hashed, kind="stable"), rows["g"].to_numpy()[row]
    same = (hashed[order][1:] == hashed[order][:-1]) & (g[order][1:] == g[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    # runs within rows: a gap between rows keeps them apart
    spread = np.zeros(len(row) + rows.num_rows, bool)
    spread[np.arange(len(row)) + row] = twice
    begin, end = _runs(spread)
    back = np.zeros(len(spread), np.int64)
    back[np.arange(len(row)) + row] = np.arange(len(row))
    begin, end = back[begin], back[end]
    of, first = row[begin], rows["first"].to_numpy().astype(np.int64)
    take = lambda c: rows[c].to_numpy()[of]
    return pa.RecordBatch.from_arrays([pa.array(take("r1")), pa.array(take("r2")), pa.array((first[of] + number[begin]).astype(np.int32)), pa.array((first[of] + number[end]).astype(np.int32))], names=["r1", "r2", "first", "last"])


def _compared(contexts: DataFrame) -> DataFrame:
    """r1, r2, first, last: the strings of contexts that repeat under one key. Sorted runs are compared whole keys at a
    time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            g = rows["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last key may go on
            ends = np.flatnonzero(np.diff(g[:cut], append=g[-1])) + 1 if cut else []
            start = 0
            for end in ends:  # some thousand rows at a time, but keys whole
                if end - start >= ROWS or end == cut:
                    yield _repeated(rows.slice(start, end - start))
                    start = end
            held, count = rows.slice(cut).to_batches(), len(g) - cut
        if held and count:
            yield _repeated(pa.Table.from_batches(held))

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "r1 long, r2 long, first int, last int")


def repeated_spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """r1, r2, spans: for each document with any, (first, last) of the starts of repeated strings. r1 and r2 are the
    document's hashes, as `references` makes them."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "suffixes")
    docs = df.select(*references(text, doc_id), F.col(text).cast("binary").alias("t")).filter(F.length("t") >= MIN_BYTES)
    runs = scratch.save(_scan(docs, "keys").groupBy("b", "g").agg(F.count("*").alias("n")))
    family, met = Family(scratch), None
    for b in range(BATCHES):
        run = scratch.save(runs.filter(F.col("b") == b).select("g", "n").sortWithinPartitions("g"))
        found = family.add(run)
        met = found if met is None else met.unionByName(found)
    scratch.drop(runs)
    records = scratch.save(_scan(docs, "records", fixed_bitmap(met.select(F.col("g").alias("k")))))
    for level in family.levels.values():
        scratch.drop(level)
    classes = scratch.save(records.groupBy("g", "h").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    whole = records.join(classes.filter("n > 1").select("g", "h"), ["g", "h"], "left_semi").select("r1", "r2", "first", "last")
    apart = classes.groupBy("g").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select("g")
    told = classes.join(apart, "g", "left_semi").select(F.col("id").alias("k"))
    spans = whole.unionByName(_compared(_scan(docs, "contexts", fixed_bitmap(told))))
    return spans.groupBy("r1", "r2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def references(text: str, doc_id: str) -> list[Column]:
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("r1"), F.xxhash64(F.lit(1), F.col(text)).alias("r2")]


def remove(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with kept (binary: the bytes that stay) and removed_spans: array of (start, length) in bytes, in place of any
    columns of these names."""
    df = df.drop(*[c for c in ("kept", "removed_spans") if c not in (text, doc_id)])
    r1, r2, found, done = fresh(df, "r1", "r2", "found", "done")
    spans = repeated_spans(df, text, doc_id).toDF(r1, r2, found)
    both = df.withColumns({c: e for c, e in zip((r1, r2), references(text, doc_id), strict=True)}).join(spans, [r1, r2], "left")

    @F.arrow_udf("kept binary, removed_spans array<struct<start:int,length:int>>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        kept, removed = [], []
        for t, s in zip(texts, found, strict=True):
            data, gone = t.as_py() or b"", []
            if s.is_valid and len(s):
                pairs = s.values.flatten()
                first, last = pairs[0].to_numpy(), pairs[1].to_numpy()
                marks = np.zeros(len(data) + 1, np.int64)
                np.add.at(marks, first, 1)
                np.add.at(marks, last + MIN_BYTES, -1)
                covered = np.cumsum(marks[:-1]) > 0
                begin, end = _runs(covered)
                gone = [{"start": a, "length": b - a + 1} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                data = np.frombuffer(data, np.uint8)[~covered].tobytes()
            kept.append(data)
            removed.append(gone)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], names=["kept", "removed_spans"])

    out = both.withColumn(done, cut(F.col(text).cast("binary"), F.col(found)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], f"{done}.kept", f"{done}.removed_spans")
