"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut by the tokenizer's pattern. Pieces of chunks not met before are encoded together: pieces of like length fill
one padded matrix of token ids; each round every row merges its leftmost pair of minimum rank, which shortens all
rows by one column. Merged ids come from a hash table of pairs. Pieces beyond `LONG` bytes, where a merge a round
would take quadratic time, go through a heap over a linked list with the same order of merges.

A null text counts as empty: no ids, no bytes. An empty table gives an empty table. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import kept

#: No merge.
NONE = np.int32(2**31 - 1)
#: Bytes of a piece from which the heap is used.
LONG = 256
#: Cells of one matrix at most.
CELLS = 1 << 21
#: Pieces that a worker keeps, and their characters; it starts anew beyond them, so that memory stays bounded.
KEPT, KEPT_CHARS = 300_000, 16_000_000
#: Fixed value: the pattern for which texts may be cut at lone spaces, and words need no pattern. With any other, a text is
#: cut by its pattern alone.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairTable:
    """Open addressing: pair of ids -> merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = (left.astype(np.int64) << 31) | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot, one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair does not merge; ids below 0 are padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = (left.astype(np.int64) << 31) | right.astype(np.int64)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[todo])
        mask = len(self.keys) - 1
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out.reshape(shape)


class Encoder:
    """Encodes and decodes by the ranks of a vocabulary; an id is a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # Rust's \s is White_Space; Python's also takes the separators 1C to 1F
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks, self.by_words = ranks, pattern == WORDS
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        top = max(ranks.values()) + 1
        words = [b""] * top
        for w, r in ranks.items():
            words[r] = w
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.at = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.used = self.chars = 0

    def _keep(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        k, n = len(self.index), len(keys)
        while k + n > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[k : k + n], self.size[k : k + n] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.chars += sum(map(len, keys))
        self.index.update(zip(keys, range(k, k + n), strict=True))

    def _pieces(self, key: str) -> list[str]:
        """Keys of the pieces of a new chunk; a lone word, and a word with one mark after it, need no pattern."""
        if not self.by_words:
            return [key]  # chunks are pieces then
        if key.isalpha():
            return [key]
        if key[-1] in ".,;:!?|" and key[:-1].isalpha():
            return [key[:-1], f" {key[-1]}"]
        return [_key(p) for p in self.cut(key[1:] if key[0] == " " else f" {key}")]

    def _learn(self, keys: list[str]) -> None:
        """keys: of chunks; after a space a chunk's text itself, else its text without the space before it."""
        cut = [self._pieces(k) for k in keys]
        pieces = list(dict.fromkeys(p for c in cut for p in c if p not in self.index))
        if pieces:
            self._merge(pieces)
        many = [i for i, k in enumerate(keys) if k not in self.index]
        if many:
            each = np.fromiter((self.index[p] for i in many for p in cut[i]), np.int64)
            n = self.size[each]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = self.ids[np.repeat(self.at[each] - ends[:-1], n) + np.arange(ends[-1])]
            self._keep([keys[i] for i in many], ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(cut[i]) for i in many])])]))

    def _merge(self, pieces: list[str]) -> None:
        raw = [(p[1:] if p[0] == " " else f" {p}").encode() for p in pieces]
        by: dict[int, list[int]] = {}
        flat: list[np.ndarray] = []
        owner: list[np.ndarray] = []  # which piece each of the ids belongs to
        known = self.ranks.get
        for i, b in enumerate(raw):
            if (r := known(b)) is not None:
                by.setdefault(0, []).append((i, r))
            elif len(b) > LONG:
                flat.append(self._long(b))
                owner.append(np.full(len(flat[-1]), i))
            else:
                by.setdefault((len(b) + 1) // 2 if len(b) <= 24 else 100 + len(b).bit_length(), []).append(i)
        if whole := by.pop(0, None):
            owner.append(np.array([i for i, _ in whole]))
            flat.append(np.array([r for _, r in whole], np.int32))
        for group in by.values():
            step = max(1, CELLS // max(len(raw[i]) for i in group))
            for i in range(0, len(group), step):
                self._matrix(raw, group[i : i + step], flat, owner)
        owns = np.concatenate(owner)
        order = np.argsort(owns, kind="stable")
        ids, size = np.concatenate(flat)[order], np.bincount(owns, minlength=len(pieces))
        self._keep(pieces, ids, size)

    def _matrix(self, raw: list[bytes], group: list[int], flat: list[np.ndarray], owner: list[np.ndarray]) -> None:
        """Merge the rows of one matrix until none has a pair that merges."""
        size = np.array([len(raw[i]) for i in group])
        wide = int(size.max())
        ids = self.byte[np.frombuffer(b"".join(raw[i].ljust(wide, b"\0") for i in group), np.uint8).reshape(-1, wide)]
        ids[np.arange(wide) >= size[:, None]] = -1
        rank, row = self.pairs.get(ids[:, :-1], ids[:, 1:]), np.array(group)
        while len(row):
            r = np.arange(len(row))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[r, at] if rank.shape[1] else np.full(len(row), NONE)
            go = best < NONE
            if not go.all():
                done = ids[~go]
                full = done >= 0
                flat.append(done[full])
                owner.append(np.repeat(row[~go], full.sum(1)))
                row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    break
            n, w = ids.shape
            r = np.arange(n)
            ids[r, at] = best
            keep = np.ones((n, w), bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            rank = rank[keep[:, 1:]].reshape(n, w - 2)
            left = np.flatnonzero(at > 0)
            if len(left):
                rank[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < w - 2)
            if len(right):
                rank[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = ids[i], ids[j]
            if pair not in known:
                known[pair] = int(self.pairs.get(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
            if known[pair] < NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and the offsets of the texts in them."""
        if len(self.index) > KEPT or self.chars > KEPT_CHARS:
            self._forget()
        keys: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                part = _chunks(t) if self.by_words else [_key(p) for p in self.cut(t)]
                keys += part
                count[i] = len(part)
        chunk = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(chunk < 0)
        if len(new):
            self._learn(list(dict.fromkeys(keys[i] for i in new)))
            chunk[new] = [self.index[keys[i]] for i in new]
        size = self.size[chunk]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[chunk] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(count)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts after one another, and the offsets of the texts in them."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[offsets]


#: White space but space and line feed; Python's own of it is a superset of Unicode's, so that a cut is only ever left out.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_CUT = re.compile(r"(?<=\S)(?= \S)").split


def _key(piece: str) -> str:
    """A piece by which it is known: with a space and more, what follows the space; else after one."""
    return piece[1:] if piece[0] == " " and piece[1:2].strip() else f" {piece}"


def _chunks(text: str) -> list[str]:
    """Keys of the text's chunks. It is cut before each lone space between two other characters, where every pattern
    whose pieces have a space first or among white space only cuts it too; so chunks repeat far more than texts do."""
    body = text.strip(" ")
    if not body:
        return [f" {text}"]
    if "  " in body or " \n" in body or "\n " in body or body[0] == "\n" or body[-1] == "\n" or _ODD(body):
        return [_key(c) for c in _CUT(text)]
    keys = body.split(" ")
    before, after = text.index(body[0]), len(text) - len(text.rstrip(" "))
    keys[0] = f" {' ' * before}{keys[0]}"
    if after:
        keys[-1] = f"{keys[-1]}{' ' * after}" if len(keys) == 1 else f"  {keys[-1]}{' ' * after}"
    return keys


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(sent, pattern: str) -> Encoder:
    """One for each worker; the ranks come by broadcast, so no executor needs the file."""
    digest, ranks = sent.value
    return kept(f"bpe {digest}{pattern}", lambda: Encoder(ranks, pattern))


def _runs(texts: pa.Array, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of some MB at most; one longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chars, "right")))
        yield i, j
        i = j


def _gives_back(texts: pa.Array, raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Whether the bytes of each text, none of a null one, are those decoded."""
    decoded = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    return pc.equal(pc.fill_null(texts.cast(pa.binary()), b""), decoded)


class Bpe:
    """A tokenizer over columns. path: a file of base64 tokens and ranks; pattern: what cuts texts into pieces."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern, self.sent = pattern, spark.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids", same: str | None = None) -> DataFrame:
        """df with the ids of each text, array<int>, in place of any column `out`. same: a column for whether decoding
        gives the text's bytes back, told by the worker that has encoded; decode() takes a second worker for each task,
        with tables of its own."""
        if same in (text, out):
            raise ValueError(f"{same} is a column that is read or made")
        sent, pattern = self.sent, self.pattern
        base = df.drop(*{out, same} - {text, None})
        made = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *([] if same is None else [T.StructField(same, T.BooleanType(), False)])]
        schema = T.StructType([f for f in base.schema if f.name != out] + made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = _encoder(sent, pattern)
            for b in batches:
                texts = b.column(text)
                for i, j in _runs(texts):
                    ids, offsets = e.encode(texts.slice(i, j - i).to_pylist())
                    rest, columns = b, [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                    if same is not None:
                        columns.append(_gives_back(texts.slice(i, j - i), *e.decode(ids, offsets)))
                    yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, *columns], names=[*rest.schema.names, *(f.name for f in made)])

        return base.mapInArrow(run, schema)

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for; null ids give none. Invalid UTF-8 can arise only from ids that no text gave."""
        sent, pattern = self.sent, self.pattern

        @F.arrow_udf(T.BinaryType())
        def decoded(lists: pa.Array) -> pa.Array:
            e = _encoder(sent, pattern)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat, parts, i = lists.flatten().to_numpy(zero_copy_only=False), [], 0
            while i < len(lists) or not parts:  # some 100,000 ids at a time
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 200_000, "right")) - 1)
                j = min(j, len(lists))
                raw, ends = e.decode(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)]))
                i = j
            return pa.concat_arrays(parts)

        return decoded(ids)
