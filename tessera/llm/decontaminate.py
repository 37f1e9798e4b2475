"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are lower case, runs of letters and digits; shingles are five words (a shorter text is one
shingle). A window of an item's size that resembles the item must share a shingle with it, so windows are laid where a
shared shingle lines the two up; a first pass over all shingles of all texts finds those places against the items'
shingles, broadcast in chunks of a fixed number of rows. Windows and items get SimHash fingerprints of 64 bits. Eight
blocks of eight bits are joined with one error allowed in each, which meets every pair within `RADIUS` = 15 bits: 16
errors would be needed to spoil all blocks twice. The exact weighted Jaccard similarity of the shingles, `SIMILARITY`
or more, verifies.

Items of fewer than five words are found as they are, by windows of as many words. Null or wordless texts and items
match nothing. Null ids are kept as ids. Rows that agree in id and text are one
document. Items that repeat match each. An empty table, on either side, gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 8
#: Rows of item shingles broadcast at once, some 40 bytes each.
CHUNK = 500_000


def words(text: Column) -> Column:
    """Of a text, without those that are marks only."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(df: DataFrame, key: dict[str, Column], text: str) -> DataFrame:
    """The columns of `key`, and s: hashes of all shingles in order, none for texts without words."""
    # the words are a column of their own: an expression inside a lambda would be made anew for every shingle
    cut = df.select(*[c.alias(name) for name, c in key.items()], words(F.col(text)).alias("_w"))
    count = F.greatest(F.size("_w") - (SHINGLE - 1), F.lit(1))
    # words beyond the end are null and add nothing to a hash
    hashed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)]))
    return cut.select(*key, F.when(F.size("_w") > 0, hashed).otherwise(F.array().cast("array<bigint>")).alias("s"))


def fingerprints(rows: DataFrame, key: list[str], column: str, out: str) -> DataFrame:
    """rows of `key` with the SimHash of the hashes in `column`: a bit is set if over half of them have it."""
    each = rows.select(*key, F.explode(column).alias("_h"))
    # two bits at once, in lanes of 32 bits
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(0x0000000100000001)) for i in range(32)]
    summed = each.groupBy(*key).agg(F.count("*").alias("_n"), F.array(*lanes).alias("_l"))
    bits = "aggregate(sequence(0, 63), 0L, (acc, k) -> acc | if((shiftrightunsigned(_l[k % 32], if(k < 32, 0, 32)) & 4294967295L) * 2 > _n, shiftleft(1L, k), 0L))"
    return summed.select(*key, F.expr(bits).alias(out))


def _blocks(fp: Column, near: bool) -> Column:
    """array of block keys, with those one error away if near."""
    byte = [F.shiftrightunsigned(fp, 8 * b).bitwiseAND(255) for b in range(BLOCKS)]
    flips = [0, *(1 << i for i in range(8))] if near else [0]
    return F.array(*[(byte[b].bitwiseXOR(F.lit(f)) + 256 * b).cast("int") for b in range(BLOCKS) for f in flips])


def _short(df: DataFrame, items: DataFrame, text: str, doc_id: str, item_text: str, item_id: str) -> DataFrame:
    """Places of items of fewer words than a shingle has: windows of as many words that are the same."""
    of = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("_w")).filter(F.size("_w").between(1, SHINGLE - 1))
    hashed = lambda at, n: F.xxhash64(*[F.when(F.lit(k) < n, F.get("_w", at + k)) for k in range(SHINGLE - 1)])
    of = of.select("item_id", F.size("_w").alias("width"), hashed(F.lit(0), F.size("_w")).alias("h")).distinct()
    widths = sorted(r.width for r in of.select("width").distinct().collect())
    cut = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("_w"))
    out = cut.join(of, F.lit(False)).select("doc_id", "text_hash", "item_id", F.lit(0).alias("window"), F.lit(1.0).alias("similarity"))
    for n in widths:
        places = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: hashed(i, F.lit(n)))  # noqa: B023
        each = cut.filter(F.size("_w") >= n).select("doc_id", "text_hash", F.posexplode(places).alias("window", "h"))
        found = each.join(F.broadcast(of.filter(F.col("width") == n).select("item_id", "h")), "h")
        out = out.unionByName(found.select("doc_id", "text_hash", "item_id", "window", F.lit(1.0).alias("similarity")))
    return out


def leaks(df: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, window, similarity: for each document and item the most similar window, counted in
    shingles from 0 (in words, for items of fewer words than a shingle), of those that reach `similarity`."""
    scratch = Scratch(df.sparkSession, "leaks")
    of = scratch.save(shingles(items, {"item_id": F.col(item_id), "item_hash": F.xxhash64(item_text)}, item_text)).filter(F.size("s") > 0).distinct()
    item = ["item_id", "item_hash"]
    placed = of.select(*item, F.size("s").alias("n"), F.posexplode("s").alias("offset", "h"))
    # where an item repeats a shingle, the first place lines up as well as any other: the window is verified anyway
    placed = placed.groupBy(*item, "n", "h").agg(F.min("offset").alias("offset"))
    # items that begin alike give one row for each length; chunks split the rows of a shingle too
    placed = scratch.save(placed.select("h", "n", "offset").distinct())
    chunks = -(-placed.count() // CHUNK)
    docs = shingles(df, {"doc_id": F.col(doc_id), "text_hash": F.xxhash64(text)}, text)
    key = ["doc_id", "text_hash"]
    # outer, as Spark else filters texts by their number of shingles first, for which it makes words anew for each
    hits = None
    for k in range(chunks):
        part = F.broadcast(placed.filter(F.pmod(F.xxhash64("h", "n", "offset"), F.lit(chunks)) == k))
        hit = docs.select(*key, "s", F.posexplode_outer("s").alias("at", "h")).join(part, "h")
        start = F.greatest(F.least(F.col("at") - F.col("offset"), F.size("s") - F.col("n")), F.lit(0))
        hit = hit.select(*key, start.alias("window"), "n", F.slice("s", start + 1, F.col("n")).alias("w"))
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return docs.join(of.select(*item), F.lit(False)).select(*key, "item_id", F.lit(0).alias("window"), F.lit(0.0).alias("similarity"))
    place = [*key, "window", "n"]
    windows = scratch.save(hits.groupBy(*place).agg(F.first("w").alias("w")))
    prints = fingerprints(windows, place, "w", "fp").select(*place, "fp", F.explode(_blocks(F.col("fp"), False)).alias("block"))
    # n goes through the aggregation: a join by plain equality would lose null ids
    known = fingerprints(of.select(*item, F.size("s").alias("n"), "s"), [*item, "n"], "s", "item_fp")
    known = known.select(*item, "n", "item_fp", F.explode(_blocks(F.col("item_fp"), True)).alias("block"))
    near = prints.join(known, ["n", "block"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*place, *item).distinct()
    # exact: shingles in common, each as often as both have it, against those of either
    mine = windows.select(*place, F.size("w").alias("size"), F.explode("w").alias("h")).groupBy(*place, "size", "h").agg(F.count("*").alias("c"))
    theirs = of.select(*item, F.size("s").alias("item_size"), F.explode("s").alias("h")).groupBy(*item, "item_size", "h").agg(F.count("*").alias("item_c"))
    tried = near.alias("p").join(mine.alias("m"), _all([F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in place]))
    tried = tried.select(*[F.col(f"p.{c}").alias(c) for c in [*place, *item]], "size", "h", "c")
    common = tried.alias("t").join(theirs.alias("i"), _all([F.col(f"t.{c}").eqNullSafe(F.col(f"i.{c}")) for c in [*item, "h"]]))
    common = common.groupBy(*[F.col(f"t.{c}").alias(c) for c in [*place, *item]], "size", "item_size").agg(F.sum(F.least("c", "item_c")).alias("m"))
    found = common.withColumn("similarity", F.col("m") / (F.col("size") + F.col("item_size") - F.col("m"))).filter(F.col("similarity") >= similarity)
    found = found.select(*key, "item_id", "window", "similarity").unionByName(_short(df, items, text, doc_id, item_text, item_id))
    best = found.groupBy(*key, "item_id").agg(F.max(F.struct("similarity", (-F.col("window")).alias("w"))).alias("b"))
    return best.select(*key, "item_id", (-F.col("b.w")).alias("window"), F.col("b.similarity").alias("similarity"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def clean(df: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """df without the documents that hold an item."""
    leak_id, leak_hash = fresh(df, "leak_id", "leak_hash")
    found = leaks(df, items, text, doc_id, similarity=similarity).select(F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)).distinct()
    return df.join(found, F.col(doc_id).eqNullSafe(F.col(leak_id)) & (F.xxhash64(text) == F.col(leak_hash)), "left_anti")
