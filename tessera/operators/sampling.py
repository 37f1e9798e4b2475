"""Training sets: splits, samples and negatives. Orders are hashes of ids, or ids themselves, never random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocking, features
from tessera.sources.scratch import apart


def group_split(df: DataFrame, key: Column, held_percent: int = 25, seed: int = 42) -> DataFrame:
    """df with is_validation: all rows of a key on one side, by a digest that other engines have too. Null keys are one."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn("is_validation", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < held_percent)


def sliced(df: DataFrame, order: list[Column], n_validation: int, n_train: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in an order, and those that follow them; both are what the split asks for at most."""
    both = df.orderBy(*order).limit(n_validation + n_train)
    numbered = both.withColumn("_rk", F.row_number().over(Window.orderBy(*order)))
    return numbered.filter(F.col("_rk") <= n_validation).drop("_rk"), numbered.filter(F.col("_rk") > n_validation).drop("_rk")


def stratified(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rk", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("_rk") <= n).drop("_rk")


def folds(df: DataFrame, stratum: str, order: list[Column], k: int = 5) -> DataFrame:
    """df with fold, from 1: equal parts of each stratum."""
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(stratum).orderBy(*order)))


def labelled(candidates: DataFrame, truth: DataFrame, with_truth: bool = True) -> DataFrame:
    """s1_id, tgt_id, label of candidates, and of all true pairs if asked."""
    right = truth.select("s1_id", "tgt_id").distinct().withColumn("_t", F.lit(1.0))
    pairs = candidates.select("s1_id", "tgt_id")
    if with_truth:
        pairs = pairs.unionByName(right.select("s1_id", "tgt_id"))
    return pairs.distinct().join(apart(right), ["s1_id", "tgt_id"], "left").select("s1_id", "tgt_id", F.coalesce("_t", F.lit(0.0)).alias("label"))


def capped_negatives(ranked: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each query, by rank, that are not true."""
    wrong = ranked.join(truth.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti")
    order = Window.partitionBy("s1_id").orderBy("rank")
    return wrong.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def mined(found: DataFrame, truth: DataFrame, s1: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """s1_id, tgt_id, label: the true pairs, and of each query's candidates the first n wrong ones, by rank. Pairs that the
    fast form of the features drops are neither taken nor counted, true ones too."""
    key = ["s1_id", "tgt_id"]
    right = truth.select(*key).distinct()
    wrong = found.join(right, key, "left_anti").select(*key, F.lit(0.0).alias("label"), "rank")
    both = right.select(*key, F.lit(1.0).alias("label"), F.lit(0).alias("rank")).unionByName(wrong)
    kept = features.passing(features.pairs(both, s1, targets)).select(*key, "label", "rank")
    order = Window.partitionBy("s1_id", "label").orderBy("rank", "tgt_id")
    return kept.withColumn("n", F.row_number().over(order)).filter((F.col("label") == 1) | (F.col("n") <= n)).select(*key, "label")


def first_postings(s1: DataFrame, targets: DataFrame, truth: DataFrame, cap: int = 15) -> DataFrame:
    """s1_id, tgt_id, label: the first `cap` targets of each word of three letters or more, and the true pairs."""
    words = blocking.Profile("first postings", {"token": blocking.Channel(1.0, cap)}, 0)
    asked = blocking.keys(s1, words, True).withColumnRenamed("id", "s1_id")
    met = asked.join(blocking.index(targets, words), ["country", "channel", "key"])
    known = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").join(targets.select(F.col("entity_id").alias("tgt_id")), "tgt_id", "left_semi")
    return labelled(met, known)


def sample(df: DataFrame, n: int, seed: int, *by: str) -> DataFrame:
    """n rows, the first in an order of hashes of the columns `by`; all, if there are fewer."""
    return df.orderBy(F.xxhash64(*by, F.lit(seed)), *by).limit(n)


def positives_and_random(truth: DataFrame, s1: DataFrame, targets: DataFrame, positives: int = 1_000_000, negatives: int = 400_000, seed: int = 42) -> DataFrame:
    """s1_id, tgt_id, label: a sample of the true pairs, and random pairs that are not true."""
    right = truth.select("s1_id", "tgt_id").distinct()
    wrong = random_negatives(s1, targets, negatives, seed).join(right, ["s1_id", "tgt_id"], "left_anti")
    return sample(right, positives, seed, "s1_id", "tgt_id").withColumn("label", F.lit(1.0)).unionByName(wrong.withColumn("label", F.lit(0.0)))


def random_negatives(s1: DataFrame, targets: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs of independent samples, in order of hashed ids; n bounds both."""
    order = lambda salt: [F.xxhash64("entity_id", F.lit(seed + salt)), F.col("entity_id")]
    number = lambda df, salt, name: df.orderBy(*order(salt)).limit(n).select(F.col("entity_id").alias(name), F.row_number().over(Window.orderBy(*order(salt))).alias("rn"))
    return number(s1, 0, "s1_id").join(number(targets, 1, "tgt_id"), "rn").select("s1_id", "tgt_id")


def hard_negatives(s1: DataFrame, targets: DataFrame, truth: DataFrame, kind: str) -> DataFrame:
    """s1_id, tgt_id of wrong pairs that look right. brand: of the first three targets of the root, the first wrong one.
    token: of the first word of four letters or more that targets have, the first two postings. postal: of the first
    postal code that targets have, the first two. First postings are those of least id, cut before the join."""
    keyed = {
        "brand": lambda d: F.when(F.col("brand_root") != "", F.array("brand_root")).otherwise(F.array().cast("array<string>")),
        "token": lambda d: F.array_distinct(F.filter(text.tokens(F.col("c_name")), lambda t: F.length(t) >= 4)),
        "postal": lambda d: F.col("postals"),
    }[kind]
    looked, taken = {"brand": (3, 1), "token": (2, 2), "postal": (2, 2)}[kind]
    posted = targets.select("country", F.col("entity_id").alias("tgt_id"), F.explode(keyed(targets)).alias("key"))
    first = Window.partitionBy("country", "key").orderBy("tgt_id")
    posted = posted.withColumn("rk", F.row_number().over(first)).filter(F.col("rk") <= looked)
    asked = s1.select("country", F.col("entity_id").alias("s1_id"), F.posexplode(keyed(s1)).alias("pos", "key"))
    met = asked.join(posted, ["country", "key"]).join(asked.join(posted.select("country", "key").distinct(), ["country", "key"], "left_semi").groupBy("s1_id").agg(F.min("pos").alias("least")), "s1_id").filter("pos = least")
    wrong = met.join(truth.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti")
    order = Window.partitionBy("s1_id").orderBy("rk")
    return wrong.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= taken).select("s1_id", "tgt_id")


def all_hard_negatives(s1: DataFrame, targets: DataFrame, truth: DataFrame, positives: int = 120_000, extra: int = 150_000, queries: int = 100_000, total: int = 500_000, seed: int = 42) -> DataFrame:
    """s1_id, tgt_id, kind of all three kinds, from a sample of the true pairs: the queries in it, up to `queries` for each
    kind, against the targets in it and `extra` others. `total` bounds the rows; kinds come in their order, then queries."""
    of = lambda df, key, name: df.select(F.col(key).alias(name)).distinct()
    right = sample(truth.select("s1_id", "tgt_id").distinct(), positives, seed, "s1_id", "tgt_id")
    ids = of(right, "tgt_id", "entity_id").unionByName(sample(targets.select("entity_id"), extra, seed, "entity_id")).distinct()
    known = targets.join(ids, "entity_id", "left_semi")
    asked = s1.join(of(right, "s1_id", "entity_id"), "entity_id", "left_semi")
    out = None
    for k, kind in enumerate(("brand", "token", "postal")):
        rows = hard_negatives(sample(asked, queries, seed + k, "entity_id"), known, truth, kind).select("s1_id", "tgt_id", F.lit(kind).alias("kind"), F.lit(k).alias("k"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("k", "s1_id", "tgt_id").limit(total).drop("k")
