"""Quality of match lists and of candidate generation.

Truth and predictions are long tables (s1_id, tgt_id); `queries` (s1_id) says whom to count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, truth: Column, predicted: Column) -> Column:
    """Of one query: 1 if both sets are empty, 0 if one is or nothing is common."""
    p, r = tp / predicted, tp / truth
    return F.when((truth == 0) & (predicted == 0), 1.0).when((truth == 0) | (predicted == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def counted(queries: DataFrame, truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """s1_id, n_truth, n_pred, tp in one shuffle: both tables are marked rows of one."""
    marks = truth.select("s1_id", "tgt_id").distinct().withColumn("t", F.lit(1)).withColumn("p", F.lit(0)).unionByName(predicted.select("s1_id", "tgt_id").distinct().withColumn("t", F.lit(0)).withColumn("p", F.lit(1)))
    pairs = marks.groupBy("s1_id", "tgt_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    each = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_truth"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    zero = F.lit(0).cast("long")
    return queries.join(each, "s1_id", "left").select("s1_id", *[F.coalesce(c, zero).alias(c) for c in ("n_truth", "n_pred", "tp")])


def entity_f05(queries: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return counted(queries, truth, predicted).withColumn("f05", f05(F.col("tp"), F.col("n_truth"), F.col("n_pred")))


def macro_f05(queries: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: the mean over queries, over those without and with truth, and their numbers."""
    e = entity_f05(queries, truth, predicted)
    single = F.col("n_truth") == 0
    zero = F.lit(0.0)
    return e.agg(
        F.coalesce(F.avg("f05"), zero).alias("macro_f05"),
        F.coalesce(F.avg(F.when(single, F.col("f05"))), zero).alias("singleton_f05"),
        F.coalesce(F.avg(F.when(~single, F.col("f05"))), zero).alias("matched_f05"),
        F.count("*").alias("n_queries"),
        F.count(F.when(single, 1)).alias("n_singletons"),
        F.count(F.when(~single, 1)).alias("n_matched"),
    )


def threshold_sweep(queries: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[int]) -> DataFrame:
    """threshold, macro_f05, is_best for scored (s1_id, tgt_id, score) pairs taken from each threshold on, in one pass:
    each query's counts at all thresholds are conditional sums. The first best threshold is marked."""
    right = truth.select("s1_id", "tgt_id").distinct().withColumn("t", F.lit(1))
    pairs = scored.join(right, ["s1_id", "tgt_id"], "left")
    sums = [f(F.when(F.col("score") >= x, v)).alias(f"{n}{i}") for i, x in enumerate(thresholds) for n, f, v in (("p", F.count, F.lit(1)), ("h", F.sum, F.coalesce("t", F.lit(0))))]
    each = pairs.groupBy("s1_id").agg(*sums)
    known = queries.join(right.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").join(each, "s1_id", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    wide = known.agg(*[F.avg(f05(of(f"h{i}"), of("n"), of(f"p{i}"))).alias(f"f{i}") for i in range(len(thresholds))])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"f{i}").alias("macro_f05")) for i, x in enumerate(thresholds)])).alias("r")).select("r.*")
    best = wide.select(F.array_max(F.array(*[F.struct(F.round(f"f{i}", 12).alias("f"), F.lit(-x).alias("x")) for i, x in enumerate(thresholds)])).alias("b"))
    # one row
    return long.join(F.broadcast(best)).select("threshold", "macro_f05", (F.col("threshold") == -F.col("b.x")).alias("is_best"))


def capture_report(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, and their share in percent."""
    key = ["s1_id", "tgt_id"]
    met = truth.select(*key).distinct().join(candidates.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    out = met.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_captured"))
    return out.select("n_true", "n_captured", (100.0 * F.col("n_captured") / F.greatest("n_true", F.lit(1))).alias("recall_ceiling"))


def blocking_report(s1: DataFrame, targets: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates and their share, candidates, their mean, and how much of the pair
    space they spare, in percent. All but the distinct joins are aggregates of one row."""
    pairs = candidates.select("s1_id", "tgt_id").distinct()
    right = truth.select("s1_id", "tgt_id").distinct()
    one = [
        right.agg(F.count("*").alias("n_true")),
        right.join(pairs, ["s1_id", "tgt_id"], "left_semi").agg(F.count("*").alias("n_captured")),
        pairs.agg(F.count("*").alias("n_candidates")),
        s1.agg(F.count("*").alias("n_queries")),
        targets.agg(F.count("*").alias("n_targets")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x))
    return out.select(
        "n_true", "n_captured", "n_candidates",
        (100.0 * F.col("n_captured") / F.greatest("n_true", F.lit(1))).alias("recall_ceiling"),
        (F.col("n_candidates") / F.greatest("n_queries", F.lit(1))).alias("avg_candidates"),
        (100.0 * (1 - F.col("n_candidates") / (F.col("n_queries").cast("double") * F.col("n_targets")))).alias("reduction_ratio"),
    )
