"""Near copies by SimHash and exact Jaccard similarity of word shingles; a prefix filter finds what SimHash does not link.

The SimHash operator links fingerprints of sets within its radius by Golay keys, and the exact similarity verifies. At
similarity 0.8 more bits differ than its radius has, so all pairs that it has not put into one component are then looked
for by prefixes.

Texts are sets of shingles of `width` words, those of the SimHash operator (a shorter text is one shingle). If two sets
of one fixed order of shingles are similar enough, the first shingles of each, as many as may be missing and one more,
have one in common. So only those prefixes meet. Any order is right; shingles that are frequent in a sample of the sets
come last, so that common lines bring few pairs, the others by hash. Pairs whose sets are large are then held against
each other by SimHash: at similarity 0.8 some 10 of 64 bits differ, with a deviation of 3, and pairs of up to `FAR` go
on (0.8 misses that in about two of a million). The exact similarity of the shingles verifies.

Sets that are equal are one. In each bucket of a shingle all first meet its smallest member; what that links is one
component, and only pairs whose components differ still are tried after it. In crowded buckets they are tried by what
they do not share with a pivot, a member that is met often (`_by_pivot`): the members of a large group whose edits differ
are apart by more than the threshold, and no prefix of theirs tells so. A large group of near copies then costs about its
size, not its square. Sets are not kept: those of texts that are in pairs are made again, found by a bitmap of fixed size.

Null texts count as empty; all texts without words are copies of each other. Null ids rank last. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.common import Scratch, fixed_bitmap, forget, fresh, in_bitmap, passing, released
from tessera.llm.simhash import components, majority, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
#: One text in so many is looked at for frequent shingles; so many of those texts have them at least. They set the order only.
SAMPLE, FREQUENT, MOST = 8, 8, 2_000_000
#: Bits of the fingerprints of sets of `LARGE` shingles or more that may differ.
FAR, LARGE = 24, 32
#: Members from which a bucket elects a pivot. It sets the way only, not what is found.
CROWD = 32


def _sets(texts: DataFrame, width: int, sent=None) -> DataFrame:
    """key, set of each text t, the set sorted; key is a hash of it, 0 without words. sent: a bitmap that the row's h must
    pass, looked up in the same worker, as a second one for each task would hold the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            if sent is not None:
                b = b.filter(pa.array(passing(sent.value, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
            for i in range(0, b.num_rows, 200):
                found = [np.unique(shingle_hashes(t.as_py(), width)) for t in b.column(0).slice(i, 200)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.int64()), _lists(found)], names=["key", "set"])

    return texts.select("t", *([] if sent is None else ["h"])).mapInArrow(run, "key long, set array<long>")


def _key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)))


def _sketches(docs: DataFrame, frequent, similarity: float, width: int) -> DataFrame:
    """doc_id, h and of each text t: key, n (the size of its set), fp, and the prefix of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        often = frequent.value
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                key, n, fp, prefix = [], [], [], []
                for t in part.column("t"):
                    s = np.unique(shingle_hashes(t.as_py(), width))
                    late = np.zeros(len(s), bool)
                    if len(often) and len(s):
                        late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    # rounding may only make a prefix longer
                    few = len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1
                    prefix.append(np.concatenate([s[~late], s[late]])[:few])
                    key.append(_key(s))
                    n.append(len(s))
                    fp.append(int(np.uint64(majority(s)).view(np.int64)))
                columns = [part.column("doc_id"), part.column("h"), pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), _lists(prefix)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "key", "n", "fp", "prefix"])

    schema = T.StructType([docs.schema["doc_id"], docs.schema["h"], *(T.StructField(c, k) for c, k in (("key", T.LongType()), ("n", T.IntegerType()), ("fp", T.LongType()), ("prefix", T.ArrayType(T.LongType()))))])
    return docs.select("doc_id", "h", "t").mapInArrow(run, schema)


def _alike(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, scratch: Scratch, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the similarity."""
    prints = sketches.groupBy("key").agg(F.first("fp").alias("fp"), F.first("n").alias("n"))
    left, right = (prints.select(F.col("key").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").filter((F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= FAR) | (F.greatest("n_a", "n_b") < LARGE))
    near = scratch.save(near.select("a", "b"))
    keys = scratch.save(near.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    known = scratch.save(_known(keys, docs, sketches, width))
    left, right = (known.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = near.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("m"), (F.size("set_a") + F.size("set_b")).alias("n"))
    out = scratch.save(both.filter(F.col("m") / (F.col("n") - F.col("m")) >= similarity).select("a", "b"))
    scratch.drop(known, keys, near)
    return out


def _known(keys: DataFrame, docs: DataFrame, sketches: DataFrame, width: int) -> DataFrame:
    """key, set of the keys, made again from texts."""
    keys = keys.select("key")
    rows = sketches.select("h", "key").join(keys, "key", "left_semi").select(F.col("h").alias("k"))
    told = _sets(docs, width, fixed_bitmap(rows))
    return told.join(keys, "key", "left_semi").groupBy("key").agg(F.first("set").alias("set"))


def _by_pivot(crowds: DataFrame, docs: DataFrame, sketches: DataFrame, scratch: Scratch, similarity: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of buckets (s, key, root, c members): the links (a, b) of keys with their pivots; the pairs (a, b) of keys with one
    pivot that may be similar enough; and key, pivot of those whose pairs are all among these.

    Let D be what a set and its pivot do not share. Two sets differ by |D1| + |D2| - 2 |D1 and D2|, and by at most
    r (n1 + n2) if they are similar enough, r = (1 - similarity) / (1 + similarity). If both are linked with the pivot, that
    is one component already. Otherwise their Ds must overlap by more than nothing, and where one differs much from the
    pivot, by most of them: so prefixes of the Ds meet, what the pivot does not hold before what it does."""
    r, near = (1 - similarity) / (1 + similarity), 1e-6
    often = crowds.groupBy("key").agg(F.sum("c").alias("met"))
    elected = crowds.join(often, "key").groupBy("s").agg(F.max(F.struct("met", "key")).alias("best"))
    pivots = crowds.join(elected, "s").groupBy("key").agg(F.first("root").alias("root"), F.max("best").alias("best"))
    pivots = scratch.save(pivots.select("key", "root", F.col("best.key").alias("pivot")))
    # each is in a crowd and has a pivot itself; what sends sets is most of the work, so they go once for each comparison
    known = scratch.save(_known(pivots, docs, sketches, width).join(pivots, "key"))

    def against(groups: DataFrame) -> DataFrame:
        """The members of the groups (pivot, chosen), held against the one chosen."""
        picked = groups.select(F.col("chosen").alias("key")).distinct()
        held = known.select("key", "set").filter(in_bitmap(F.col("key"), fixed_bitmap(picked.select(F.col("key").alias("k"))))).join(picked, "key", "left_semi")
        held = groups.join(held.toDF("chosen", "held"), "chosen")
        members = known.filter(in_bitmap(F.col("pivot"), fixed_bitmap(groups.select(F.col("pivot").alias("k")))))
        both = members.join(held, "pivot")
        both = both.select("key", "root", "pivot", "chosen", F.size("set").alias("n"), F.size("held").alias("p"), F.array_sort(F.array_except("set", "held")).alias("more"), F.array_sort(F.array_except("held", "set")).alias("less"))
        return both.withColumn("d", F.size("more") + F.size("less")).withColumn("m", F.col("n") - F.size("more"))

    # far from the pivot, the order of D is no better than any
    fit = F.col("d") * 2 <= F.col("n") + F.col("p")
    # a pivot's own edits are in the Ds of all: the member that has least of what most hold against the pivot takes its place
    first = scratch.save(against(pivots.select("pivot", F.col("pivot").alias("chosen")).distinct()).filter(fit).select("key", "pivot", F.concat("more", "less").alias("own")))
    many = first.groupBy("pivot").agg(F.count("*").alias("members"))
    held = first.select("pivot", F.explode("own").alias("e")).groupBy("pivot", "e").agg(F.count("*").alias("c")).join(many, "pivot").filter(F.col("c") * 2 > F.col("members"))
    compared = first.join(held.groupBy("pivot").agg(F.collect_list("e").alias("all")), "pivot", "left").withColumn("all", F.coalesce("all", F.array().cast("array<long>")))
    off = F.size("own") + F.size("all") - 2 * F.size(F.array_intersect("own", "all"))
    middle = scratch.save(compared.groupBy("pivot").agg(F.min(F.struct(off.alias("off"), "key")).alias("middle")).select("pivot", F.col("middle.key").alias("chosen")))
    both = against(middle).drop("pivot").withColumnRenamed("chosen", "pivot")
    both = both.withColumn("alike", F.col("m") / (F.col("n") + F.col("p") - F.col("m")) >= similarity)
    # how many of D another must hold at least: it differs from the pivot by over r (p + n) if this one does not
    most = r * (F.col("n") + F.col("n") / similarity)
    least = F.when(F.col("alike"), (F.col("d") + r * (F.col("p") - F.col("n"))) / 2).otherwise(F.greatest((F.col("d") - most) / 2, F.col("d") - most, F.lit(1.0)))
    few = F.greatest(F.lit(0), F.least(F.col("d"), F.floor(F.col("d") - least + 1 + near).cast("int")))
    told = scratch.save(both.select("key", "root", "pivot", "n", "d", "alike", fit.alias("fit"), F.when(fit, F.slice(F.concat("more", "less"), F.lit(1), few)).alias("prefix")))
    links = told.filter("alike and key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
    index = told.filter("fit and key <> pivot").select("key", "root", "pivot", "n", "d", "alike", F.posexplode("prefix").alias("at", "e"))
    x, y = index.filter("not alike").alias("x"), index.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("y.alike") | (F.col("x.key") < F.col("y.key")))
    overlap = F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    enough = 2 * overlap >= F.col("x.d") + F.col("y.d") - r * (F.col("x.n") + F.col("y.n")) - near
    alike_sizes = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - near
    pairs = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.e") == F.col("y.e")) & apart & enough & alike_sizes)
    pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    scratch.drop(pivots, known, first, middle)
    return links, pairs, told.filter("fit").select("key", "pivot")


def by_fingerprint(docs: DataFrame, sketches: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """a, b: pairs of sets that the SimHash operator links (equal fingerprints, or within its radius by Golay keys) and
    that are similar enough. Of sets with one fingerprint all meet the smallest key, which stands for them."""
    groups = scratch.save(sketches.groupBy("fp").agg(F.min("key").alias("a")))
    same = sketches.select("fp", "key").join(groups, "fp").filter("key <> a").select("a", F.col("key").alias("b"))
    x, y = groups.toDF("x", "a"), groups.toDF("y", "b")
    near = simhash.links(groups.select("fp")).toDF("x", "y").join(x, "x").join(y, "y").select("a", "b")
    pairs = same.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.save(pairs.distinct())
    out = _alike(pairs, docs, sketches, scratch, similarity, width)
    scratch.drop(groups, pairs)
    return out


def links(docs: DataFrame, sketches: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """a, b: of all pairs of sets that are similar enough, so many that their components are the same."""
    # equal sets fall together in the same exchange that makes the buckets
    printed = by_fingerprint(docs, sketches, scratch, similarity, width)
    known = scratch.save(components(printed, scratch)).select(F.col("node").alias("known_node"), F.col("root").alias("known_root"))
    rows = sketches.select("key", "n", F.posexplode("prefix").alias("at", "s")).repartition("s").dropDuplicates(["s", "key"])
    bucket = Window.partitionBy("s")
    met = rows.withColumn("first", F.min(F.struct("key", "n", "at")).over(bucket)).withColumn("c", F.count("*").over(bucket)).filter("c > 1").drop("c")
    met = scratch.save(met)

    def possible(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
        # at the first shingle that two sets have in common, all others in common come after it
        most = F.least(n - at, other_n - other_at)
        return (F.least(n, other_n) >= similarity * F.greatest(n, other_n) - 1e-6) & (most >= similarity / (1 + similarity) * (n + other_n) - 1e-6)

    tried = met.filter((F.col("key") != F.col("first.key")) & possible(F.col("n"), F.col("at"), F.col("first.n"), F.col("first.at")))
    tried = tried.select(F.col("first.key").alias("a"), F.col("key").alias("b")).distinct()
    # what the fingerprints have linked need not be tried again
    tried = tried.join(known, F.col("a") == F.col("known_node"), "left").withColumn("at_a", F.coalesce("known_root", "a")).drop("known_node", "known_root")
    tried = tried.join(known, F.col("b") == F.col("known_node"), "left").filter(F.col("at_a") != F.coalesce("known_root", "b"))
    tried = scratch.save(tried.select("a", "b"))
    found = printed.unionByName(_alike(tried, docs, sketches, scratch, similarity, width)).distinct()
    roots = scratch.save(components(found, scratch))
    marked = met.join(roots, met["key"] == roots["node"], "left").select("s", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    # buckets of one component have nothing left to tell
    apart = marked.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).withColumn("c", F.count("*").over(bucket)).filter("low <> high").select("s", "key", "n", "at", "root", "c")
    apart = scratch.save(apart)
    found_too, pairs, pivots = _by_pivot(apart.filter(F.col("c") >= CROWD), docs, sketches, scratch, similarity, width)
    found = found.unionByName(found_too)
    apart = apart.join(pivots, "key", "left")
    x, y = apart.alias("x"), apart.alias("y")
    # pairs of one pivot are told by it
    other = F.coalesce(F.col("x.pivot") != F.col("y.pivot"), F.lit(True))
    rest = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & other & possible(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")))
    rest = rest.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).unionByName(pairs)
    rest = scratch.save(rest.distinct().join(tried, ["a", "b"], "left_anti"))
    scratch.drop(met, tried)
    return found.unionByName(_alike(rest, docs, sketches, scratch, similarity, width))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """df with one row of each component of near copies, that of the smallest id. Rows that agree in all columns stay or
    go together."""
    scratch = Scratch(df.sparkSession, "nearcopies")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    docs = df.select(F.col(doc_id).alias("doc_id"), row.alias("h"), F.col(text).alias("t"))
    sample = _sets(docs.filter(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0), width)
    often = sample.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT)
    # MOST longs at the most
    with released(df.sparkSession):
        frequent = np.sort(np.array([r.s for r in often.orderBy(F.desc("c"), "s").limit(MOST).select("s").collect()], np.int64).view(np.uint64))
    sketches = scratch.save(_sketches(docs, df.sparkSession.sparkContext.broadcast(frequent), similarity, width))
    roots = components(links(docs, sketches, scratch, similarity, width), scratch)
    marked = sketches.select("doc_id", "h", "key").join(roots, sketches["key"] == roots["node"], "left")
    # the winner of a component is an aggregate over (id, row's hash), which combines before it is shuffled
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    marked = scratch.save(marked.select("doc_id", "h", F.coalesce("root", "key").alias("root")))
    won = marked.groupBy("root").agg(F.min(order).alias("o"))
    lost_id, lost_row = fresh(df, "lost_id", "lost_row")
    lost = marked.join(won, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("h") == F.col("o.h"))))
    lost = scratch.save(lost.select(F.col("doc_id").alias(lost_id), F.col("h").alias(lost_row)).distinct())
    # few go: rows that a bitmap of the lost ones does not hold need no shuffle
    maybe = in_bitmap(row, fixed_bitmap(lost.select(F.col(lost_row).alias("k"))))
    held = df.filter(maybe).join(lost, F.col(doc_id).eqNullSafe(F.col(lost_id)) & (row == F.col(lost_row)), "left_anti")
    return df.filter(~maybe).unionByName(held)
