"""Candidate generation: one equi-join on (country, channel, key), a sum of weights, and the best K of each query.

Frequencies are counted before the join, so a key over its channel's ceiling never meets the queries, and a channel's
cap bounds what any key can bring. Weights are integers of 1e-9, whose sums do not depend on order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import classes, cosine
from tessera.sources.scratch import Scratch, apart, single

UNIT = 1_000_000_000


@dataclass(frozen=True)
class Channel:
    weight: float
    cap: int | None = None  # postings of a key that count, the first by source and id
    max_df: int | None = None  # keys of more records are dropped
    idf: bool = False  # divide the weight by 1 + ln(1 + records)


@dataclass(frozen=True)
class Profile:
    """Constants of one generation of the pipeline. ngrams: "compact" (of the compact name) or "raw"."""

    name: str
    channels: dict[str, Channel] = field(hash=False)
    top_k: int
    ngrams: str = "raw"
    repeated_numbers: bool = False
    threshold: float = 0.5
    caps: tuple[int, int] = (5, 6)


def _profiles() -> dict[str, Profile]:
    # Weights, caps, frequency ceilings, K, thresholds and caps per source.
    c = Channel
    v3 = {"exact": c(5.0, 10), "prefix2": c(3.5, 10), "compact": c(4.0, 10)}
    v6 = {"exact": c(5.0, 8), "prefix2": c(3.5, 8), "compact": c(4.0, 8), "token": c(1.5, 15, 4000, True), "number": c(2.0, 10, 1500)}
    rows = [
        Profile("base", {"exact": c(5.0), "prefix2": c(3.0), "token": c(1.0, None, 15000, True), "number": c(2.0)}, 25, threshold=0.65),
        Profile("base17", {"exact": c(5.0), "prefix2": c(3.0), "token": c(1.0, None, 30000, True), "number": c(2.0)}, 25, threshold=0.65),
        Profile("high_recall", {"exact": c(6.0), "prefix2": c(3.5), "token": c(1.5, None, 25000, True), "char3": c(0.2, None, 25000, True), "number": c(2.5)}, 30, "compact"),
        Profile("v2", {"prefix2": c(3.5), "token": c(1.5, None, 15000, True), "char3": c(0.25, None, 15000, True)}, 25, "compact", threshold=0.48),
        Profile("v3", v3 | {"token": c(1.5, None, 15000, True), "char3": c(0.25, None, 15000, True), "number": c(2.0)}, 25, threshold=0.68),
        Profile("v3fast", v3 | {"token": c(1.5, 20, 3000, True), "number": c(2.0, 15, 1500)}, 25, threshold=0.68),
        Profile("v4", {"exact": c(6.0, 10), "prefix2": c(4.0, 10), "compact": c(5.0, 10), "root": c(4.5, 10), "token": c(1.5, 20, 5000, True), "number": c(2.5, 15, 2000)}, 30, repeated_numbers=True, threshold=0.62),
        Profile("v5", {"exact": c(6.0, 8), "prefix2": c(4.0, 8), "compact": c(5.0, 8), "root": c(4.5, 8), "token": c(1.5, 12, 3000, True), "number": c(2.5, 10, 1200)}, 25, repeated_numbers=True, threshold=0.65, caps=(4, 4)),
        Profile("v6", v6, 20, repeated_numbers=True, threshold=0.70, caps=(3, 3)),
        Profile("stage1", v6, 20, repeated_numbers=True, caps=(3, 3)),
        Profile("stage2", v6, 15, repeated_numbers=True, caps=(3, 3)),
    ]
    return {p.name: p for p in rows}


PROFILES = _profiles()


def channel_keys(channel: str, profile: Profile, query: bool) -> Column:
    """array of a record's keys in a channel, from its c_name and c_addr."""
    name, address = F.col("c_name"), F.col("c_addr")
    none = F.array().cast("array<string>")
    one = lambda k, fine: F.when(fine, F.array(k)).otherwise(none)
    if channel == "exact":
        return one(name, name != "")
    if channel == "prefix2":
        return one(text.prefix2(name), text.prefix2(name).isNotNull())
    if channel == "compact":
        return one(text.compact(name), F.length(text.compact(name)) >= 5)
    if channel == "root":
        return one(text.brand_root(name), F.length(text.brand_root(name)) >= 4)
    if channel == "token":
        return F.array_distinct(F.filter(text.tokens(name), lambda t: F.length(t) >= 3))
    if channel == "char3":
        return text.char_ngrams(text.compact(name), short="whole") if profile.ngrams == "compact" else text.char_ngrams(name)
    return text.number_locality(address, distinct=not (query and profile.repeated_numbers))


def keys(records: DataFrame, profile: Profile, query: bool) -> DataFrame:
    """country, channel, key, id for all of a profile's channels."""

    def named(channel: str) -> Column:
        return F.transform(channel_keys(channel, profile, query), lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))

    each = [named(c) for c in profile.channels]
    # outer, as Spark else filters records by their number of keys first, for which it makes all of them twice
    exploded = records.select("country", F.col("entity_id").alias("id"), F.explode_outer(F.concat(*each)).alias("k"))
    return exploded.select("country", "k.channel", "k.key", "id").filter("key is not null")


def _by_channel(profile: Profile, value) -> Column:
    out = F.lit(None)
    for name, c in profile.channels.items():
        out = F.when(F.col("channel") == name, F.lit(value(c))).otherwise(out)
    return out


def index(targets: DataFrame, profile: Profile) -> DataFrame:
    """country, channel, key, tgt_id, w: what a query that holds the key gains for each target."""
    cell = ["country", "channel", "key"]
    # counted where the postings meet, so that they are made and shuffled once
    posted = keys(targets, profile, False).withColumn("df", F.count("*").over(Window.partitionBy(*cell)))
    posted = posted.filter(F.coalesce(F.col("df") <= _by_channel(profile, lambda c: c.max_df), F.lit(True)))
    idf = 1 + F.log(1 + F.col("df").cast("double"))
    weight = _by_channel(profile, lambda c: float(c.weight)) / F.when(_by_channel(profile, lambda c: c.idf), idf).otherwise(1.0)
    posted = posted.withColumn("w", F.floor(weight * UNIT).cast("long")).drop("df")
    capped = [n for n, c in profile.channels.items() if c.cap is not None]
    if not capped:
        return posted.select(*cell, F.col("id").alias("tgt_id"), "w")
    first = Window.partitionBy(*cell).orderBy(F.substring("id", 1, 2), "id")
    most = max(profile.channels[n].cap for n in capped)
    kept = posted.filter(F.col("channel").isin(capped)).withColumn("rk", F.row_number().over(first)).filter(F.col("rk") <= most)
    kept = kept.filter(F.col("rk") <= _by_channel(profile, lambda c: c.cap)).drop("rk")
    free = [n for n in profile.channels if n not in capped]
    if free:
        kept = kept.unionByName(posted.filter(F.col("channel").isin(free)))
    return kept.select(*cell, F.col("id").alias("tgt_id"), "w")


#: Classes of targets that one task holds, besides the targets of capped keys; classes of queries of a task, at the least and at the most.
SHARD, BLOCK, MOST = 262_144, 512, 65_536
#: Numbers that a task keeps of the names, and of the addresses, that it has met.
KEPT = 8_000_000


def _repeated(records: DataFrame) -> bool:
    """Whether an id occurs twice; what such records bring is summed, so they cannot be scored one by one."""
    return not records.groupBy("entity_id").count().filter("count > 1").isEmpty()


def _columns(profile: Profile) -> list[str]:
    """What a record's keys depend on."""
    names, numbers = [n for n in profile.channels if n != "number"], "number" in profile.channels
    return [*(["c_name"] if names else []), *(["c_addr"] if numbers else [])]


def _telling(records: DataFrame) -> DataFrame:
    """records without the addresses that hold no number: they give no key."""
    if "c_addr" not in records.columns:
        return records
    return records.withColumn("c_addr", F.when(~F.col("c_addr").rlike(r"\b\d+\b"), "").otherwise(F.col("c_addr")))


def _first(id_: str) -> Column:
    return F.struct(F.substring(id_, 1, 2).alias("src"), F.col(id_).alias("id"))


class _Index:
    """Which rows hold a key, of a column of lists of keys."""

    def __init__(self, lists: pa.ChunkedArray):
        keys_, sizes = _flat(lists)
        order = np.argsort(keys_, kind="stable")
        self.n, self.keys, self.rows = len(sizes), keys_[order], np.repeat(np.arange(len(sizes)), sizes)[order]

    def sums(self, keys_: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What each row gains from a query's keys."""
        total = np.zeros(self.n, np.int64)
        for a, b, w in zip(np.searchsorted(self.keys, keys_), np.searchsorted(self.keys, keys_, "right"), weights, strict=True):
            total[self.rows[a:b]] += w
        return total


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists, and the lists' lengths."""
    whole = lists.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False), np.diff(whole.offsets.to_numpy())


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.empty(0, np.int64)


def _kept(make):
    """make, whose results are kept by their first argument until they hold too many numbers."""
    known, held = {}, 0

    def get(name, *args):
        nonlocal held
        if name not in known:
            if held > KEPT:
                known.clear()
                held = 0
            known[name] = out = make(*args)
            held += sum(len(x) for x in out)
        return known[name]

    return get


def _best(top_k: int):
    """Of each query class of a block the units of a shard that may hold one of its K best targets. A score is that of two
    names and that of two addresses. A unit whose address brings nothing can only be one of the best if it is one of the
    best by names, which all queries of a name share; so only units whose address brings something are gone through for each
    query, those that it brings most first, until no name can make up for the rest."""
    wanted = 2 * top_k  # a target may be in two units, as one of its class and by itself

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            names, places = (right.filter(pa.compute.equal(right.column("kind"), k)) for k in (0, 1))
            units, sizes = _flat(names.column("units"))
            held, group = np.zeros(units.max() + 1, np.int64), np.zeros(units.max() + 1, np.int64)
            held[units], group[units] = _flat(names.column("many"))[0], np.repeat(np.arange(len(sizes)), sizes)
            units = units[np.lexsort((units, group[units]))]
            starts, by_name = np.cumsum(sizes) - sizes, _Index(names.column("keys"))
            there, counts = _flat(places.column("units")) if places.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64))
            begins, by_place = np.cumsum(counts) - counts, _Index(places.column("keys")) if places.num_rows else None

            def named(keys_: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """What names gain, and the best units by names alone with their scores."""
                total = by_name.sums(keys_, weights)
                near = np.flatnonzero(total)
                near = near[np.argsort(-total[near], kind="stable")]
                few = np.minimum(sizes[near], wanted)
                if len(near) and few.sum() > wanted:
                    fine = total[near] >= total[near[np.searchsorted(np.cumsum(few), wanted)]]
                    near, few = near[fine], few[fine]
                found = units[_runs(starts[near], few)]
                found = found[np.lexsort((found, -total[group[found]]))[:wanted]]
                return total, found, total[group[found]]

            def placed(keys_: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Units whose addresses gain, and what, the most first."""
                if by_place is None:
                    return np.empty(0, np.int64), np.empty(0, np.int64)
                total = by_place.sums(keys_, weights)
                near = np.flatnonzero(total)
                near = near[np.argsort(-total[near], kind="stable")]
                return there[_runs(begins[near], counts[near])], np.repeat(total[near], counts[near])

            named, placed = _kept(named), _kept(placed)
            lists = [np.split(v, np.cumsum(n)[:-1]) for v, n in (_flat(left.column(f"q_{c}")) for c in ("nk", "nw", "ak", "aw"))]
            for at, (name, place) in enumerate(zip(left.column("q_name").to_pylist(), left.column("q_place").to_pylist(), strict=True)):
                total, near, score = named(name, lists[0][at], lists[1][at])
                here, gain = placed(place, lists[2][at], lists[3][at])
                if len(here):
                    least, some = score[-1] if len(score) == wanted else 0, 4 * wanted
                    both = gain[:some] + total[group[here[:some]]]
                    if len(both) > wanted:
                        least = max(least, np.partition(both, -wanted)[-wanted])
                    end = int(np.searchsorted(-gain, total.max(initial=0) - least, "right"))
                    if end > some:
                        both = np.concatenate([both, gain[some:end] + total[group[here[some:end]]]])
                        least = max(least, np.partition(both, -wanted)[-wanted])
                    # a unit that is in both is the first time here with its whole score
                    near, score = np.concatenate([here[: len(both)], near]), np.concatenate([both, score])
                    near, score = near[score >= least], score[score >= least]
                    order = np.lexsort((near, -score))
                    near, score = near[order], score[order]
                    once = np.sort(np.unique(near, return_index=True)[1])[:wanted]
                    near, score = near[once], score[once]
                # no other is needed below a score that K targets of classes surpass
                ahead = np.cumsum(held[near])
                above = np.searchsorted(-score, -score, side="left")
                fine = np.where(above > 0, ahead[above - 1], 0) < top_k if len(near) else np.empty(0, bool)
                out[0].append(np.full(int(fine.sum()), at))
                out[1].append(near[fine])
                out[2].append(score[fine])
        q, u, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        where = [right.column(c)[0].as_py() for c in ("country", "shard")] if right.num_rows else [None, None]
        asked = left.column("q_q").take(pa.array(q)) if len(q) else pa.array([], pa.string())
        return pa.table({"country": pa.array([where[0]] * len(q), pa.string()), "shard": pa.array([where[1]] * len(q), pa.int64()), "q": asked, "u": pa.array(u.astype(np.int32)), "s": pa.array(s)})

    return run


def _candidates_by_class(s1: DataFrame, targets: DataFrame, profile: Profile, top_k: int) -> DataFrame:
    """`candidates` for profiles with channels that have no cap, where a common key brings very many pairs. Records of
    the same texts have the same keys: they are one class, scored once. A class keeps its first K targets, as no other can
    be among a query's K best. Targets that a capped key has kept score more than their class and are units by themselves.
    All queries of a block are held against all units of a shard (see `_best`), so no pair is shuffled but the best. Ids
    must be unique."""
    cols = _columns(profile)
    by = ["country", *cols]
    free = [n for n, c in profile.channels.items() if c.cap is None]
    capped = [n for n in profile.channels if n not in free]
    # if numbers are capped, a target has its own of them, and is scored as a whole
    two = "number" in free
    name_by, place_by = ["country", *(c for c in cols if c != "c_addr" or not two)], ["country", "c_addr"]
    prefixed = lambda c, query: F.transform(channel_keys(c, profile, query), lambda k: F.concat(F.lit(f"{c}:"), k))
    array = lambda channels, query: F.concat(F.array().cast("array<string>"), *[prefixed(c, query) for c in channels])
    of_names, of_places = (lambda channels: [c for c in channels if c != "number" or not two]), (lambda channels: [c for c in channels if c == "number" and two])
    channel = F.substring_index("k", ":", 1).alias("channel")

    scratch = Scratch(s1.sparkSession, "candidates")

    def grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = scratch.save(df.filter("country is not null").select(*by, F.col("entity_id").alias("id")))
        return rows, rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(_first("id")).alias("o"))

    tgt, whole = grouped(targets)
    asked, asking = grouped(s1)
    # weights, from the frequencies of all records
    posted = whole.select("country", "n", F.explode(array(profile.channels, False)).alias("k"))
    df = posted.groupBy("country", "k").agg(F.sum("n").alias("df")).withColumn("channel", channel)
    df = df.filter(F.coalesce(F.col("df") <= _by_channel(profile, lambda c: c.max_df), F.lit(True)))
    weight = _by_channel(profile, lambda c: float(c.weight)) / F.when(_by_channel(profile, lambda c: c.idf), 1 + F.log(1 + F.col("df").cast("double"))).otherwise(1.0)
    weights = df.select("country", "k", F.floor(weight * UNIT).cast("long").alias("w"))
    weights = scratch.save(weights.withColumn("key", F.monotonically_increasing_id()))
    # the first targets of each class
    most = max([top_k, *(profile.channels[n].cap for n in capped)])
    inside = Window.partitionBy(*by).orderBy(F.substring("id", 1, 2), "id")
    members = tgt.withColumn("at", F.row_number().over(inside)).filter(F.col("at") <= most)
    units = whole.select(*by, "o", F.least("n", F.lit(top_k)).cast("int").alias("many"), F.array().cast("array<string>").alias("own"))
    if capped:
        first = Window.partitionBy("country", "k").orderBy(F.substring("id", 1, 2), "id")
        kept = members.select("country", "id", F.explode(array(capped, False)).alias("k")).withColumn("rk", F.row_number().over(first)).withColumn("channel", channel)
        kept = kept.filter(F.col("rk") <= _by_channel(profile, lambda c: c.cap)).groupBy("country", "id").agg(F.collect_list("k").alias("own"))
        single = members.join(kept, ["country", "id"]).select(*by, _first("id").alias("o"), F.lit(0).alias("many"), "own")
        units = units.unionByName(single)
    count = lambda df, name, size: df.groupBy("country").agg(F.ceil(F.count("*") / size).cast("long").alias(name))
    parallel = s1.sparkSession.sparkContext.defaultParallelism
    shards = scratch.save(count(whole, "shards", SHARD))
    # so many blocks as keep all cores busy, for each of which the units are sent once more
    enough = -(-4 * parallel // (shards.agg(F.sum("shards")).first()[0] or 1))
    blocks = asking.groupBy("country").agg(F.count("*").alias("c")).select("country", F.greatest(F.ceil(F.col("c") / MOST), F.least(F.ceil(F.col("c") / BLOCK), F.lit(enough))).cast("long").alias("blocks"))
    blocks = scratch.save(blocks)
    units = units.join(F.broadcast(shards), "country").withColumn("shard", F.pmod(F.xxhash64("o.id"), "shards"))
    # by source and id, so that ties go to the smaller number; a class goes after its own first target
    numbered = Window.partitionBy("country", "shard").orderBy("o.src", "o.id", "many")
    units = scratch.save(units.withColumn("u", F.row_number().over(numbered) - 1))

    def weighed(df: DataFrame, each: list[str], made: Column) -> DataFrame:
        """The keys of each distinct text, with their weights."""
        rows = df.select(*each).distinct().select(*each, F.explode(made).alias("k")).join(weights, ["country", "k"])
        return rows.groupBy(*each).agg(F.collect_list(F.struct("key", "w")).alias("l"))

    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    none = F.array().cast("array<long>")
    named = units.groupBy(*name_by, "own", "shard").agg(F.collect_list(F.struct("u", "many")).alias("us"))
    named = named.join(weighed(units, [*name_by, "own"], F.concat(array(of_names(free), False), "own")), [*name_by, "own"], "left")
    right = named.select("country", "shard", F.lit(0).alias("kind"), F.coalesce("l.key", none).alias("keys"), F.col("us.u").alias("units"), F.col("us.many").alias("many"))
    if of_places(free):
        placed = units.groupBy(*place_by, "shard").agg(F.collect_list("u").alias("us")).join(weighed(units, place_by, array(of_places(free), False)), place_by)
        right = right.unionByName(placed.select("country", "shard", F.lit(1).alias("kind"), F.col("l.key").alias("keys"), F.col("us").alias("units"), F.array().cast("array<int>").alias("many")))
    right = right.join(F.broadcast(blocks), "country").select("country", "shard", every("blocks").alias("block"), "kind", "keys", "units", "many")
    left = asking.join(F.broadcast(blocks), "country").join(F.broadcast(shards), "country")
    for c, each, channels in (("n", name_by, of_names(profile.channels)), ("a", place_by, of_places(profile.channels))):
        if channels:
            left = left.join(weighed(asking, each, array(channels, True)).withColumnRenamed("l", f"l{c}"), each, "left")
            left = left.withColumns({f"{c}k": F.coalesce(f"l{c}.key", none), f"{c}w": F.coalesce(f"l{c}.w", none), f"{c}t": F.to_json(F.struct(*each))})
        else:
            left = left.withColumns({f"{c}k": none, f"{c}w": none, f"{c}t": F.lit("")})
    # queries of one address in one block, but for those whose address says nothing
    block = F.pmod(F.when(F.size("ak") > 0, F.xxhash64("at")).otherwise(F.xxhash64("o.id")), "blocks").alias("block")
    left = left.filter((F.size("nk") > 0) | (F.size("ak") > 0)).select("country", every("shards").alias("shard"), block, F.col("o.id").alias("q"), F.col("nt").alias("name"), F.col("at").alias("place"), "nk", "nw", "ak", "aw")
    cell = ["country", "shard", "block"]
    left, right = left.toDF(*(f"q_{c}" for c in left.columns)), right.toDF(*right.columns)
    asked_in = [f"q_{c}" for c in cell]
    best = scratch.save(left.repartition(4 * parallel, *asked_in).groupBy(*asked_in).cogroup(right.repartition(4 * parallel, *cell).groupBy(*cell)).applyInArrow(_best(top_k), "country string, shard long, q string, u int, s long"))
    # units turn into targets
    named = best.join(units.select("country", "shard", "u", *by[1:], "o", "many"), ["country", "shard", "u"])
    several = named.filter("many > 0").join(members.filter(F.col("at") <= top_k), by).select("country", "q", "id", "s")
    found = several
    if capped:
        found = several.unionByName(named.filter("many = 0").select("country", "q", "o.id", "s")).groupBy("country", "q", "id").agg(F.max("s").alias("s"))
    order = Window.partitionBy("country", "q").orderBy(F.desc("s"), F.substring("id", 1, 2), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    # classes of queries turn into queries
    asked = asked.join(asking.select(*by, F.col("o.id").alias("q")), by).select("country", "q", F.col("id").alias("s1_id"))
    return asked.join(found, ["country", "q"]).select("s1_id", F.col("id").alias("tgt_id"), F.round(F.col("s") / UNIT, 6).alias("score"), "rank")


def candidates(s1: DataFrame, targets: DataFrame, profile: Profile, top_k: int | None = None) -> DataFrame:
    """s1_id, tgt_id, score, rank: the K targets of each query with the largest sums; ties by source, then id."""
    if any(c.cap is None for c in profile.channels.values()) and not (_repeated(s1) or _repeated(targets)):
        return _candidates_by_class(s1, targets, profile, top_k or profile.top_k)
    scratch, by = Scratch(s1.sparkSession, "candidates"), ["country", *_columns(profile)]
    # written, as whole texts take long to normalise
    s1, targets = (scratch.save(_telling(df.filter("country is not null").select("entity_id", *by))) for df in (s1, targets))
    if _repeated(s1):  # what such queries gain is summed over their records
        asked, members = s1, None
    else:  # queries of the same texts have the same candidates
        texts, members = classes.of(s1, by, scratch)
        asked = texts.select(F.col("class").alias("entity_id"), *by)
    asked = keys(asked, profile, True).withColumnRenamed("id", "q")
    summed = apart(asked).join(index(targets, profile), ["country", "channel", "key"]).groupBy("q", "tgt_id").agg(F.sum("w").alias("s"))
    best = Window.partitionBy("q").orderBy(F.desc("s"), F.substring("tgt_id", 1, 2), "tgt_id")
    ranked = summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= (top_k or profile.top_k))
    ranked = ranked.withColumnRenamed("q", "s1_id") if members is None else ranked.join(apart(members.toDF("q", "s1_id")), "q")
    return ranked.select("s1_id", "tgt_id", F.round(F.col("s") / UNIT, 6).alias("score"), "rank")


#: Queries, and targets, of a block of `tfidf_cosine`.
COSINES = 2048


def _step() -> Column:
    """A sixteenth of an octave, of a text's length."""
    return F.floor(16 * F.log2(1 + F.length("t"))).alias("step")


def _longest(held: DataFrame) -> dict[str, tuple[int, int]]:
    """Of each country the step of length from which on some COSINES / 2 texts are, or else one text in so many from there."""
    out: dict[str, tuple[int, int]] = {}
    for country, step, n in sorted(held.groupBy("country", _step()).count().collect(), key=lambda r: -r[1]):
        many = out.get(country, (0, 0))[1]
        if many < COSINES // 2:
            out[country] = (step, many + n)
    return {c: (step, -(-many // COSINES)) for c, (step, many) in out.items()}


def tfidf_cosine(s1: DataFrame, targets: DataFrame, top_k: int = 20, floor: float = 0.15, min_df: int = 2, vocabulary: int = 100_000) -> DataFrame:
    """s1_id, tgt_id, cosine over counted 3- and 4-grams of padded words, with smoothed idf and unit lengths."""

    scratch = Scratch(s1.sparkSession, "cosine")
    both = targets.select("country", "entity_id", "c_name", "c_addr").unionByName(s1.select("country", "entity_id", "c_name", "c_addr")).filter("country is not null")
    # records of one id are one text
    docs = both.groupBy("country", F.col("entity_id").alias("id")).agg(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "c_name", "c_addr"))).alias("t"), F.count("*").alias("rows"))
    docs = scratch.save(docs)
    # one row for each country and for each gram
    n = docs.groupBy("country").agg(F.sum("rows").alias("n"))
    counted = docs.select("country", "t").mapInArrow(cosine.frequencies, "country string, g string, df long, total long")
    df = counted.groupBy("country", "g").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter(F.col("df") >= min_df)
    often = Window.partitionBy("country").orderBy(F.desc("total"), "g")
    idf = df.withColumn("rk", F.row_number().over(often)).filter(F.col("rk") <= vocabulary).join(n, "country").select("country", "g", "total", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # at most `vocabulary` grams of a country, those that weigh most first
    words: dict[str, tuple[list[str], np.ndarray]] = {}
    table = idf.toArrow()
    for c in table.column("country").unique().to_pylist():
        part = table.filter(pa.compute.equal(table.column("country"), c))
        weigh = part.column("idf").to_numpy()
        order = np.argsort(-part.column("total").to_numpy() * weigh * weigh, kind="stable")
        words[c] = (part.column("g").take(pa.array(order)).to_pylist(), weigh[order])
    sent = s1.sparkSession.sparkContext.broadcast(words)
    asked, held = docs.filter("id like 'S1-%'"), docs.filter("id not like 'S1-%'")
    sizes = [{r[0]: r[1] for r in d.groupBy("country").count().collect()} for d in (asked, held)]
    longest, parts = _longest(held), 16 * s1.sparkSession.sparkContext.defaultParallelism
    found = None

    def packed(d: DataFrame, country: str, block: Column, blocks: int) -> DataFrame:
        texts = d.filter(F.col("country") == country).select(block.cast("long").alias("block"), "id", "t")
        # some blocks in a partition, as a pair of partitions is read by one task
        return scratch.save(texts.repartition(min(blocks + 1, parts), "block").groupBy("block").applyInArrow(cosine.pack(sent, country), cosine.PACKED))

    def met(left: DataFrame, right: DataFrame, country: str, whole: bool) -> DataFrame:
        """Every block of left with every block of right: both are read, none is shuffled, and a batch is one pair of blocks."""
        pairs = left.toDF(*(f"q_{c}" for c in left.columns)).hint("shuffle_replicate_nl").crossJoin(right)
        made = pairs.mapInArrow(cosine.met(sent, country, top_k, floor, whole), "block long, least array<double>, s1_ids array<string>, tgt_ids array<string>, cosines array<double>")
        with single(s1.sparkSession):
            return scratch.save(made)

    for c in sorted(set(words) & set(sizes[0]) & set(sizes[1])):
        q, t = (-(-n[c] // COSINES) for n in sizes)
        left = packed(asked, c, F.pmod(F.xxhash64("id"), F.lit(q)), q)
        # most queries are near to the longest: what those reach, others must surpass
        step, one_in = longest[c]
        ahead = (_step() >= step) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(one_in)) == 0)
        right = packed(held, c, F.when(ahead, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(t))), t)
        lead = met(left.withColumn("least", F.array().cast("array<double>")), right.filter("block < 0"), c, True)
        rest = met(left.join(F.broadcast(lead.select("block", "least")), "block", "left"), right.filter("block >= 0"), c, False)
        both = lead.unionByName(rest)
        found = both if found is None else found.unionByName(both)
        scratch.drop(left, right)
    scratch.drop(docs)
    if found is None:
        return s1.sparkSession.createDataFrame([], "s1_id string, tgt_id string, cosine double, rank int")
    near = found.select(F.explode(F.arrays_zip("s1_ids", "tgt_ids", "cosines")).alias("f")).select(F.col("f.s1_ids").alias("s1_id"), F.col("f.tgt_ids").alias("tgt_id"), F.col("f.cosines").alias("cosine"))
    best = Window.partitionBy("s1_id").orderBy(F.desc(F.round("cosine", 9)), "tgt_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select("s1_id", "tgt_id", F.round("cosine", 6).alias("cosine"), "rank")


def _agreeing(asked: DataFrame, whole: DataFrame) -> DataFrame:
    """class of queries of which a hit of more than three is taken for its postal code. No pair of classes is made."""
    found = []
    for name, fine in (("c_name", "c_name <> ''"), ("comp_name", "length(comp_name) >= 5")):
        many = whole.filter(fine).groupBy("country", name).agg(F.sum("n").alias("n_hits")).filter("n_hits > 3").select("country", name)
        held = whole.filter(fine).select("country", name, F.col("c_name").alias("other"), F.explode("postals").alias("postal"))
        held = held.groupBy("country", name, "postal").agg(F.min("other").alias("low"), F.max("other").alias("high")).join(apart(many), ["country", name])
        hits = asked.filter(fine).select("class", "country", F.col("c_name").alias("own"), name, F.explode("postals").alias("postal")).join(apart(held), ["country", name, "postal"])
        # an exact hit is not tried as a compact one
        found.append((hits if name == "c_name" else hits.filter("own = '' or low <> own or high <> own")).select("class"))
    return found[0].unionByName(found[1]).distinct()


def _cascade(s1: DataFrame, targets: DataFrame, taken: bool = False, made=None, lists: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first tier's pairs of classes (a_class, b_class, score), and the records of both sides' classes. taken: only the
    classes of queries that a hit takes, as a_class; pairs are made for those only that postal codes do not settle. made:
    gives raw records their columns. lists: ids of records come as lists."""
    scratch, cols = Scratch(s1.sparkSession, "cascade"), ["country", "c_name", "c_addr", "comp_name", "numbers", "postals"]
    # hits are pairs of classes, as scores depend on texts alone
    (a, asked), (whole, held) = (classes.of(df, cols, scratch, ["country", "business_name", "business_address"], made) for df in (s1, targets))
    if lists:
        asked, held = (scratch.save(classes.lists(*x)) for x in ((a, asked), (whole, held)))
    sure = scratch.save(_agreeing(a, whole)) if taken else None
    if taken:
        a = a.join(apart(sure), "class", "left_anti")
    a = a.select("country", *[F.col(c).alias(f"a_{c}") for c in ("class", *cols[1:])])
    b = whole.select("country", *[F.col(c).alias(f"b_{c}") for c in ("class", *cols[1:])])
    exact = a.join(b, (a["country"] == b["country"]) & (F.col("a_c_name") == F.col("b_c_name"))).filter("a_c_name <> ''").drop(b["country"])
    comp = a.join(b, (a["country"] == b["country"]) & (F.col("a_comp_name") == F.col("b_comp_name"))).filter("length(a_comp_name) >= 5").drop(b["country"])

    def tier(hits: DataFrame, name: str, scores: tuple[float, float, float, float]) -> DataFrame:
        of = whole.filter(F.col(name) != "").groupBy("country", F.col(name).alias("hit_key")).agg(F.sum("n").alias("n_hits"))
        hits = hits.join(of.withColumnRenamed("country", "hit_country"), (F.col("country") == F.col("hit_country")) & (F.col(f"b_{name}") == F.col("hit_key")))
        sims = similarity.similarities(F.col("a_c_addr"), F.col("b_c_addr"), ["ratio", "token_set"])
        hits = hits.withColumn("sim", sims)
        pins, nums = F.arrays_overlap("a_postals", "b_postals"), F.arrays_overlap("a_numbers", "b_numbers")
        both = lambda c: (F.size(f"a_{c}") > 0) & (F.size(f"b_{c}") > 0)
        conflict = (both("postals") & ~pins) | (both("numbers") & ~nums & (F.col("sim.ratio") < 70))
        common = F.when(both("postals") & pins, scores[1]).when(both("numbers") & nums & (F.col("sim.token_set") >= 60), scores[2]).when(F.col("sim.token_set") >= 75, scores[3])
        return hits.select("a_class", "b_class", F.when(F.col("n_hits") <= 3, F.when(~conflict, scores[0])).otherwise(common).alias("score"))

    first = tier(exact, "c_name", (1.0, 0.95, 0.90, 0.85))
    second = tier(comp.filter("a_c_name <> b_c_name or a_c_name = ''"), "comp_name", (0.98, 0.92, 0.88, 0.82))
    scored = first.unionByName(second).filter("score is not null")
    scored = scratch.save(scored.select("a_class").unionByName(sure.toDF("a_class")).distinct() if taken else scored)
    return scored, asked.toDF("a_class", "s1_id"), held.toDF("b_class", "tgt_id")


def cascade(s1: DataFrame, targets: DataFrame, made=None) -> DataFrame:
    """s1_id, tgt_id, score: first-tier hits by exact or compact name. Up to three hits are taken unless postal codes or
    numbers conflict; more must agree in their addresses. An exact hit is not tried as a compact one. made: gives raw
    records the columns that the others have, once for each text."""
    scored, asked, held = _cascade(s1, targets, made=made, lists=True)
    pairs = apart(scored).join(apart(asked.toDF("a_class", "s1_ids")), "a_class").join(apart(held.toDF("b_class", "tgt_ids")), "b_class")
    # records of a pair of classes are paired row by row, so no join has as many rows as the result
    return pairs.select("score", "tgt_ids", F.explode("s1_ids").alias("s1_id")).select("s1_id", F.explode("tgt_ids").alias("tgt_id"), "score")


def second_tier(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, tgt_id, score, rank: candidates of the queries of which the first tier took no hit at all."""
    scored, asked, _ = _cascade(s1, targets, taken=True)
    taken = Scratch(s1.sparkSession, "taken").save(asked.join(apart(scored), "a_class").select(F.col("s1_id").alias("entity_id")).distinct())
    # what a query gets does not depend on the others
    return candidates(s1.join(apart(taken), "entity_id", "left_anti"), targets, PROFILES["v2"])
