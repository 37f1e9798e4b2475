"""String similarity kernels on code points, and one Arrow UDF that gives them all for a batch of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, a bit for each character of a."""
    if a == b:
        return len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for equal texts, two empty ones too; insertions and deletions count one each."""
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a window of the longer one, also one that hangs over an end."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    n, best, letters = len(a), 0.0, set(a)
    for i in range(1 - n, len(b)):
        window = b[max(0, i) : i + n]
        # a best window ends, and begins, with a letter of the shorter text
        if (window[-1] if i <= len(b) - n else window[0]) in letters:
            best = max(best, ratio(a, window))
    if len(a) == len(b):
        for i in range(1 - n, n):
            best = max(best, ratio(b, a[max(0, i) : i + n]))
    return best


def _sorted(x: str) -> str:
    return " ".join(sorted(x.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def _sets(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_set_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    if not a.split() or not b.split():
        return 0.0
    if both and (not left or not right):
        return 100.0
    shared = " ".join(both)
    x, y = " ".join([*both, *left]), " ".join([*both, *right])
    best = ratio(x, y)
    return max(best, ratio(shared, x), ratio(shared, y)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    if both:
        return 100.0
    whole = partial_ratio(_sorted(a), _sorted(b))
    return max(whole, partial_ratio(" ".join(left), " ".join(right)))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the kernels, those on parts and on tokens scaled down."""
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if long < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if long <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; up to four equal first letters add a tenth each of what is missing."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, places = max(0, max(len(a), len(b)) // 2 - 1), {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    used, mine = 0, []
    for i, c in enumerate(a):
        # the first place of the letter in reach that is free
        first = max(0, i - reach)
        free = places.get(c, 0) & ~used & ((1 << max(0, i + reach + 1 - first)) - 1) << first
        if free:
            used |= free & -free
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for j, c in enumerate(b) if used >> j & 1]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


KERNELS = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "wratio": weighted_ratio, "jaro_winkler": jaro_winkler}

#: Pairs that are worked on at once, side by side.
LANES = 4096


def _letters(texts: list[str], filler: int) -> np.ndarray:
    """(longest, n): the code points of each text in a column."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(size.max(initial=0))), filler, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return np.ascontiguousarray(out.T)


def _lanes(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """Pairs of like lengths together, by their numbers."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    return [np.array(order[i : i + LANES]) for i in range(0, len(order), LANES)]


def lcs_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Of the longest common subsequence of each pair: a word of 64 bits for each shorter text, one letter of all longer
    texts at a time; texts of over 64 letters one by one."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    out = np.zeros(len(pairs), np.int64)
    short = [i for i, (a, _) in enumerate(pairs) if 0 < len(a) <= 64]
    for i, (a, b) in enumerate(pairs):
        if len(a) > 64:
            out[i] = _lcs(a, b)
    for lane in _lanes([pairs[i] for i in short]):
        these = np.array(short)[lane]
        a, b = _letters([pairs[i][0] for i in these], -1), _letters([pairs[i][1] for i in these], -2)
        alphabet, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        at = at.reshape(len(a) + len(b), -1)
        who, masks = np.arange(len(these)), np.zeros((len(alphabet), len(these)), np.uint64)
        for k in range(len(a)):
            masks[at[k], who] |= np.uint64(1 << k)
        masks[: np.searchsorted(alphabet, 0)] = 0  # fillers match nothing
        rows = np.full(len(these), (1 << 64) - 1, np.uint64)
        for k in range(len(b)):
            hit = rows & masks[at[len(a) + k], who]
            rows = (rows + hit) | (rows - hit)
        size = np.array([len(pairs[i][0]) for i in these])
        rows |= np.where(size < 64, ~np.uint64(0) << np.minimum(size, 63).astype(np.uint64), np.uint64(0))
        out[these] = np.bitwise_count(~rows)
    return out


def _ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    size = np.array([len(a) + len(b) for a, b in pairs], np.int64)
    return np.where(size > 0, 200.0 * lcs_lengths(pairs) / np.maximum(size, 1), 100.0)


def _windows(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each short text, none empty, to a window of its long one.

    One walk over both texts gives, for each letter p of the long one, the least start of windows in which p adds nothing
    to the subsequence that they have in common with the short one; a window's length of it is how many of its letters
    have that at its start or before."""
    n, m = np.array([len(x) for x in short]), np.array([len(x) for x in long])
    a, b = _letters(short, -1), _letters(long, -2)
    kind = np.int16 if len(b) < 32_000 else np.int32
    least = np.repeat(np.arange(1, len(b) + 1, dtype=kind)[:, None], len(short), axis=1)
    for letter in a:
        same, carried = b == letter, np.zeros(len(short), kind)
        for j in range(len(b)):
            here = least[j]
            swap = same[j] | (here < carried)
            least[j], carried = np.where(swap, carried, here), np.where(swap, here, carried)
    best = np.zeros(len(short))
    place = np.arange(len(b))[:, None]
    for start in range(len(b)):
        end = np.minimum(start + n, m)
        stop = int(end.max())
        inside = (least[start:stop] <= start) & (place[start:stop] < end)
        np.maximum(best, np.where(end > start, 200.0 * inside.sum(0) / (n + np.maximum(end - start, 1)), 0.0), out=best)
    # windows that hang over the beginning
    held = np.cumsum(least <= 0, axis=0)
    for end in range(1, min(len(a), len(b) + 1)):
        np.maximum(best, np.where((end < n) & (end <= m), 200.0 * held[end - 1] / (n + end), 0.0), out=best)
    return best


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    out = np.array([100.0 if a == b or (a and b and (a in b or b in a)) else 0.0 for a, b in pairs])
    todo = [i for i, (a, b) in enumerate(pairs) if a and b and out[i] == 0]
    shorter = [pairs[i] if len(pairs[i][0]) <= len(pairs[i][1]) else pairs[i][::-1] for i in todo]
    for lane in _lanes(shorter):
        out[np.array(todo)[lane]] = _windows([shorter[i][0] for i in lane], [shorter[i][1] for i in lane])
    even = [i for i in todo if len(pairs[i][0]) == len(pairs[i][1])]
    for k in range(0, len(even), LANES):
        part = even[k : k + LANES]
        out[part] = np.maximum(out[part], _windows([pairs[i][1] for i in part], [pairs[i][0] for i in part]))
    return out


def all_kernels(kernels: list[str], pairs: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The kernels of many pairs, each as the function of one pair says, from shared parts."""
    out: dict[str, np.ndarray] = {}
    wanted = set(kernels) | ({"ratio", "token_sort", "token_set"} if "wratio" in kernels else set())
    if "ratio" in wanted:
        out["ratio"] = _ratios(pairs)
    if "partial" in wanted:
        out["partial"] = partial_ratios(pairs)
    if "jaro_winkler" in wanted:
        out["jaro_winkler"] = np.array([jaro_winkler(a, b) for a, b in pairs])
    if "token_sort" in wanted:
        in_order = [(_sorted(a), _sorted(b)) for a, b in pairs]
        out["token_sort"] = _ratios(in_order)
    if "token_set" in wanted:
        sets = [_sets(a, b) for a, b in pairs]
        rest = [(" ".join(left), " ".join(right)) for _, left, right in sets]
        # what both begin with is in every longest common subsequence
        common = np.array([len(" ".join(both)) for both, _, _ in sets], np.int64)
        lead = np.where(common > 0, common + 1, 0)
        x, y = (np.array([len(r[k]) for r in rest], np.int64) + lead for k in (0, 1))
        best = 200.0 * (lcs_lengths(rest) + lead) / np.maximum(x + y, 1)
        shared = np.maximum(200.0 * common / np.maximum(common + x, 1), 200.0 * common / np.maximum(common + y, 1))
        best = np.where(common > 0, np.maximum(best, shared), best)
        within = np.array([bool(both) and not (left and right) for both, left, right in sets])
        none = np.array([not a.split() or not b.split() for a, b in pairs])
        out["token_set"] = np.where(none, 0.0, np.where(within, 100.0, best))
    if "wratio" in wanted:
        size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
        empty, long = (size == 0).any(1), size.max(1) / np.maximum(size.min(1), 1)
        weighed = np.maximum(out["ratio"], 0.95 * np.maximum(out["token_sort"], out["token_set"]))
        parts = np.flatnonzero(~empty & (long >= 1.5))
        if len(parts):
            scale = np.where(long[parts] <= 8, 0.9, 0.6)
            part = out["partial"][parts] if "partial" in out else partial_ratios([pairs[i] for i in parts])
            apart = [i for i in parts if not sets[i][0]]
            tokens = np.full(len(pairs), 100.0)
            if apart:
                tokens[apart] = np.maximum(partial_ratios([in_order[i] for i in apart]), partial_ratios([rest[i] for i in apart]))
            weighed[parts] = np.maximum(out["ratio"][parts], np.maximum(scale * part, 0.95 * scale * tokens[parts]))
        out["wratio"] = np.where(empty, 0.0, weighed)
    return {k: out[k] for k in kernels}


def similarities(a: Column, b: Column, kernels: list[str]) -> Column:
    """A struct with the kernels asked for; one pass through Python for all, each distinct pair of a batch once."""

    @F.arrow_udf("struct<" + ",".join(f"{k}:double" for k in kernels) + ">")
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        both = list(zip(x.to_pylist(), y.to_pylist(), strict=True))
        number: dict[tuple[str, str], int] = {}
        at = np.array([-1 if p[0] is None or p[1] is None else number.setdefault(p, len(number)) for p in both], np.int64)
        values = all_kernels(kernels, list(number)) if number else {k: np.zeros(1) for k in kernels}
        return pa.StructArray.from_arrays([pa.array(values[k][at], pa.float64(), mask=at < 0) for k in kernels], names=kernels)

    return made(a, b)


def jaccard(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / (union + epsilon))
