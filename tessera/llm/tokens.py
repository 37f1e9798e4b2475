"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by length once; sums from the longest length down then answer, for every context limit, how
many documents and tokens reach beyond it, what truncation keeps, and which length stands at any quantile. Lengths are
summed in two levels, runs of `RUN` lengths and then within each run, so no task holds the histogram whole.

A null text has length 0, as the empty one. An empty table gives an empty table; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import Bpe
from tessera.llm.common import Scratch

RUN = 1024


def histogram(df: DataFrame, bpe: Bpe, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    lengths = bpe.encode(df.select(F.col(text).alias("text"))).select(F.size("ids").cast("long").alias("n_tokens"))
    # written, as more than one sum reads it and texts should be encoded once
    return Scratch(df.sparkSession, "lengths").save(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def by_limit(hist: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: documents and tokens at it, below it and from it on, and the
    tokens that truncation to it keeps."""
    h = hist.withColumn("run", F.floor(F.col("n_tokens") / RUN)).withColumn("n_sum", F.col("n_tokens") * F.col("n_docs"))
    runs = h.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum("n_sum").alias("t"))
    later, earlier = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    runs = runs.select("run", F.coalesce(F.sum("d").over(later), none).alias("d_after"), F.coalesce(F.sum("t").over(later), none).alias("t_after"), F.coalesce(F.sum("d").over(earlier), none).alias("d_before"), F.coalesce(F.sum("t").over(earlier), none).alias("t_before"))
    down = Window.partitionBy("run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("run").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(runs, "run").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.sum("n_docs").over(up) + F.col("d_before")).alias("docs_within"),
        (F.sum("n_sum").over(up) + F.col("t_before")).alias("tokens_within"),
        (F.sum("n_docs").over(down) + F.col("d_after")).alias("docs_from"),
        (F.sum("n_sum").over(down) + F.col("t_after")).alias("tokens_from"),
    )
    return out.withColumn("tokens_kept", F.col("tokens_within") + F.col("context_limit") * (F.col("docs_from") - F.col("n_docs")))


def quantiles(limits: DataFrame, qs: list[float]) -> DataFrame:
    """q, n_tokens: the least length within which at least a share q of the documents lies."""
    spark = limits.sparkSession
    total = limits.agg(F.max("docs_within").alias("total"))
    wanted = spark.createDataFrame([(float(q),) for q in qs], "q double")
    # one row of totals and the few given quantiles: sizes that the data do not change
    return limits.join(F.broadcast(total.join(F.broadcast(wanted))), F.col("docs_within") >= F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("total") - 1e-9))).groupBy("q").agg(F.min("context_limit").alias("n_tokens"))


def totals_at(limits: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, also one that no document has: documents over it, all tokens, tokens kept."""
    return limits.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.when(F.col("context_limit") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("context_limit")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("context_limit"), F.lit(limit))), F.lit(0)).alias("tokens_kept"),
    )
