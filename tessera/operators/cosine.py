"""Exact nearest texts by cosines of counted 3- and 4-grams. Texts become vectors once, packed by blocks; every block of
queries meets every block of targets without a shuffle. A dense product of bounds tells which pairs can be among the best,
and only those are worked out exactly."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Words whose grams are kept at once.
KEPT = 200_000
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def grams(word: str) -> list[str]:
    """Of a word padded by a space at either end; one no longer than three signs then is one gram."""
    w = f" {word} "
    return [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)] if len(w) > 3 else [w]


class Counted:
    """Numbers of the grams of texts, and how often they occur. number: of a gram, or None if it does not count."""

    def __init__(self, number):
        self.number, self.words = number, {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts, times = [], []
        for word, n in Counter(_SPACE.split(text or "")).items():
            if not word:
                continue
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) > KEPT:
                    self.words.clear()
                ids = self.words[word] = np.array([k for k in map(self.number, grams(word)) if k is not None], np.int64)
            parts.append(ids)
            times.append(np.full(len(ids), n, np.int64))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids, back = np.unique(np.concatenate(parts), return_inverse=True)
        return ids, np.bincount(back, np.concatenate(times), len(ids)).astype(np.int64)


#: A gram of these signs has a number of its own: of its three or four signs, each counted from 1.
SIGNS = " abcdefghijklmnopqrstuvwxyz0123456789"
_BASE = len(SIGNS) + 1
_SIGN = np.zeros(256, np.int32)
_SIGN[[ord(c) for c in SIGNS]] = np.arange(1, _BASE)
_SIGN[[ord(c) for c in "\t\n\x0b\f\r"]] = 1


def codes(text: str) -> np.ndarray | None:
    """Of all grams of a text, in no order; None if it has other signs."""
    if not text.isascii():
        return None
    m = _SIGN[np.frombuffer(f" {text} ".encode(), np.uint8)]
    if not m.all():
        return None
    inner = m != 1
    pairs = m[:-1] * _BASE + m[1:]
    three, four = pairs[:-1] * _BASE + m[2:], pairs[:-2] * (_BASE * _BASE) + pairs[2:]
    # no space inside a gram
    return np.concatenate([three[inner[1:-1]], four[inner[1:-2] & inner[2:-1]]])


def code(gram: str) -> int | None:
    """Of one gram; None if it has other signs."""
    out = 0
    for c in gram:
        if c not in SIGNS:
            return None
        out = out * _BASE + SIGNS.index(c) + 1
    return out


def gram(number: int) -> str:
    out = ""
    while number:
        number, sign = divmod(number, _BASE)
        out = SIGNS[sign - 1] + out
    return out


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often they occur."""
    values = np.sort(values)
    ends = np.flatnonzero(np.concatenate([values[1:] != values[:-1], [True]])) if len(values) else np.empty(0, np.int64)
    return values[ends], np.diff(ends, prepend=-1)


class Vectors:
    """Texts of a country as numbers of grams and how often they occur. names: its grams; others do not count."""

    def __init__(self, names: list[str]):
        self.table, self.odd = np.full(_BASE**4, -1, np.int32), Counted({g: k for k, g in enumerate(names)}.get)
        at = [(n, k) for k, g in enumerate(names) if len(g) in (3, 4) and (n := code(g)) is not None]
        self.table[[n for n, _ in at]] = [k for _, k in at]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = codes(text or "")
        if found is None:
            return self.odd.of(text)
        ids = self.table[found]
        return _counts(ids[ids >= 0])


#: Grams that wait for being summed up.
WAIT = 4_000_000


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """country, g, df, total of a task's texts (country, t)."""
    summed: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    odd: dict[str, tuple[dict[str, int], Counted, Counter, Counter]] = {}
    held = 0

    def merge() -> None:
        for country, parts in waiting.items():
            if country in summed:
                parts.append(summed[country])
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
            sums = np.concatenate([n if n.ndim == 2 else np.stack([np.ones_like(n), n]) for _, n in parts], axis=1)[:, order]
            summed[country] = (keys[order][starts], np.add.reduceat(sums, starts, axis=1) if len(starts) else sums)
        waiting.clear()

    for b in batches:
        for country, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = codes(t or "")
            if found is None:
                if country not in odd:
                    number: dict[str, int] = {}
                    odd[country] = (number, Counted(lambda g, number=number: number.setdefault(g, len(number))), Counter(), Counter())
                ids, tf = (x.tolist() for x in odd[country][1].of(t))
                odd[country][2].update(ids)
                odd[country][3].update(dict(zip(ids, tf, strict=True)))
                continue
            waiting.setdefault(country, []).append(_counts(found))
            held += len(waiting[country][-1][0])
            if held > WAIT:
                merge()
                held = 0
    merge()
    rows = [(c, [gram(k) for k in keys.tolist()], *sums) for c, (keys, sums) in summed.items()]
    rows += [(c, list(number), *(np.array([x[i] for i in range(len(number))], np.int64) for x in (df, total))) for c, (number, _, df, total) in odd.items()]
    for country, names, df, total in rows:
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([country] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(df[i : i + len(part)]), pa.array(total[i : i + len(part)])], names=["country", "g", "df", "total"])


#: A block of texts: their ids, how many grams each has, those, and how often they occur.
PACKED = "block long, ids array<string>, sizes array<int>, grams binary, times binary"
_TYPES = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary())


def _bytes(x: np.ndarray) -> bytes:
    """In two bytes for each, or in four where that is too few."""
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def pack(sent, country: str):
    """One row for all texts (block, id, t) of a block. sent: of a country, its grams and their weights."""
    made: list[Vectors] = []

    def run(texts: pa.Table) -> pa.Table:
        if not made:
            made.append(Vectors(sent.value[country][0]))
        held = [made[0].of(t) for t in texts.column("t").to_pylist()]
        none = np.empty(0, np.int64)
        grams_, times = (_bytes(np.concatenate([h[k] for h in held] or [none])) for k in (0, 1))
        row = (texts.column("block")[0].as_py(), texts.column("id").to_pylist(), [len(i) for i, _ in held], grams_, times)
        return pa.table([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=["block", "ids", "sizes", "grams", "times"])

    return run


#: Numbers of a bound, how many queries meet a block at a time, and how many grams a whole product takes at a time.
BOUND, STRIP, PART = 3072, 256, 1024
#: What products of single precision may be short of the bound: they have BOUND terms of one sign and a sum of 1 at most.
SHORT = (BOUND + 16) * 2.0**-24


class Block:
    """Unit vectors, exact, and the lengths of their parts in BOUND groups of grams. A product of lengths is no less than
    that of the parts, so that of all groups is no less than the cosine. Grams that weigh most have groups of their own."""

    def __init__(self, sizes: list[int], grams_: bytes, times: bytes, idf: np.ndarray):
        self.sizes = np.array(sizes, np.int64)
        self.ids, tf = (np.frombuffer(x, np.uint32 if len(x) == 4 * self.sizes.sum() else np.uint16) for x in (grams_, times))
        self.starts, self.x = np.cumsum(self.sizes) - self.sizes, np.empty(len(tf))
        # by strips, as what is made on the way is several times the vectors
        for _, n, row, at in self._strips():
            x = tf[at] * idf[self.ids[at]]
            self.x[at] = x / np.sqrt(np.bincount(row, x * x, n))[row]

    def _strips(self) -> Iterator[tuple[int, int, np.ndarray, slice]]:
        """Of some rows the first and how many, the row of each number, and where these are."""
        for a in range(0, len(self.sizes), STRIP):
            sizes = self.sizes[a : a + STRIP]
            yield a, len(sizes), np.repeat(np.arange(len(sizes)), sizes), slice(self.starts[a], self.starts[a] + sizes.sum())

    @cached_property
    def bound(self) -> np.ndarray:
        alone, out = BOUND // 2, np.empty((len(self.sizes), BOUND), np.float32)
        for a, n, row, at in self._strips():
            ids = self.ids[at].astype(np.int64)
            place = row * BOUND + np.where(ids < alone, ids, alone + (ids - alone) % (BOUND - alone))
            out[a : a + n] = np.sqrt(np.bincount(place, self.x[at] * self.x[at], n * BOUND)).reshape(n, BOUND)
        return out

    def part(self, a: int) -> np.ndarray:
        """The vectors' numbers of PART grams from one on."""
        out = np.zeros((len(self.sizes), PART))
        for first, _, row, at in self._strips():
            here = np.flatnonzero((self.ids[at] >= a) & (self.ids[at] < a + PART))
            out[first + row[here], self.ids[at][here].astype(np.int64) - a] = self.x[at][here]
        return out


def _all(left: Block, right: Block, least: np.ndarray, top_k: int, floor: float, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """`_best` of long texts, which bounds hardly tell apart: all cosines from whole products."""
    total = np.zeros((len(left.sizes), len(right.sizes)))
    for a in range(0, width, PART):
        total += left.part(a) @ right.part(a).T
    for i, score in enumerate(total):
        near = np.flatnonzero(score > floor)
        if len(near) > top_k:
            near = near[score[near] >= np.partition(score[near], -top_k)[-top_k] - 2e-9]
        if len(near):
            yield i, near, score[near]


def _cosines(q: np.ndarray, block: Block, near: np.ndarray) -> np.ndarray:
    """Of a query with some of a block."""
    sizes = block.sizes[near]
    ends = np.cumsum(sizes)
    at = np.repeat(block.starts[near] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return np.bincount(np.repeat(np.arange(len(near)), sizes), q[block.ids[at]] * block.x[at], len(near))


def _best(left: Block, right: Block, least: np.ndarray, top_k: int, floor: float, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query the targets of a block above the floor that may be among its K best, and their cosines. least: what
    K targets of other blocks reach."""
    q = np.zeros(width)
    for a in range(0, len(left.sizes), STRIP):
        bounds = left.bound[a : a + STRIP] @ right.bound.T
        # what ties with the last when rounded stays, until ids decide
        lows = np.maximum(floor, least[a : a + STRIP] - 2e-9)
        may = bounds >= (lows - SHORT).astype(np.float32)[:, None] - np.float32(1e-7)
        for i in np.flatnonzero(may.any(1)) + a:
            bound, low, near = bounds[i - a], lows[i - a], np.flatnonzero(may[i - a])
            mine = slice(left.starts[i], left.starts[i] + left.sizes[i])
            q[left.ids[mine]] = left.x[mine]
            if len(near) > 4 * top_k:
                first = near[np.argpartition(-bound[near], 2 * top_k)[: 2 * top_k]]
                low = max(low, np.partition(_cosines(q, right, first), -top_k)[-top_k] - 2e-9)
                near = near[bound[near] >= low - SHORT]
            score = _cosines(q, right, near)
            q[left.ids[mine]] = 0
            near, score = near[(score > floor) & (score >= low)], score[(score > floor) & (score >= low)]
            if len(near) > top_k:
                fine = score >= np.partition(score, -top_k)[-top_k] - 2e-9
                near, score = near[fine], score[fine]
            yield i, near, score


def met(sent, country: str, top_k: int, floor: float, whole: bool):
    """Of each pair of a block of queries and one of targets the pairs of `_best`, or of `_all`; `least` is what K targets found
    before reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = sent.value[country]
        kept: dict[str, tuple[int, Block]] = {}

        def block(side: str, row: dict) -> Block:
            if side not in kept or kept[side][0] != row[f"{side}block"]:
                kept[side] = (row[f"{side}block"], Block(*(row[f"{side}{c}"] for c in ("sizes", "grams", "times")), idf))
            return kept[side][1]

        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                left, right = block("q_", row), block("", row)
                least = np.array(row["q_least"] or [0.0] * len(row["q_ids"]))
                out: tuple[list, list, list] = ([], [], [])
                for i, near, score in (_all if whole else _best)(left, right, least, top_k, floor, len(names)):
                    out[0].extend([row["q_ids"][i]] * len(near))
                    out[1].extend(row["ids"][j] for j in near.tolist())
                    out[2].extend(score.tolist())
                    if len(near) >= top_k:
                        least[i] = max(least[i], score.min())
                # queries without K targets have no least
                made = [row["q_block"], least.tolist(), *out]
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, kinds, strict=True)], names=["block", "least", "s1_ids", "tgt_ids", "cosines"])

    return run
