"""From scored pairs to match lists: threshold, conflict guards, caps per source, one list for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conflict(a: Column, b: Column, name_ratio: Column, least: float) -> Column:
    """Both sides have some, none in common, and the names are less alike than `least` (0 to 100)."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b) & (name_ratio < least)


def guarded(pairs: DataFrame, name_ratio: Column) -> DataFrame:
    """pairs without those whose postal codes or numbers conflict."""
    return pairs.filter(~conflict(F.col("a_postals"), F.col("b_postals"), name_ratio, 90) & ~conflict(F.col("a_numbers"), F.col("b_numbers"), name_ratio, 85))


def capped(scored: DataFrame, caps: dict[str, int], score: str = "score") -> DataFrame:
    """The best of each query and source; `rank` counts from 1 within them. Sources without a cap keep all."""
    source = F.substring("tgt_id", 1, 2)
    best = Window.partitionBy("s1_id", source).orderBy(F.desc(score), "tgt_id")
    most = F.lit(None).cast("int")
    for name, n in caps.items():
        most = F.when(source == name, n).otherwise(most)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.coalesce(F.col("rank") <= most, F.lit(True)))


def match_lists(ranked: DataFrame, s1: DataFrame) -> DataFrame:
    """s1_id, ids: a comma list by source, then rank; queries without matches get the empty one."""
    entry = F.struct(F.substring("tgt_id", 1, 2).alias("src"), "rank", "tgt_id")
    lists = ranked.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["tgt_id"]), ",").alias("ids"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"))


def counters(lists: DataFrame) -> DataFrame:
    """n_queries, n_singletons, n_matched (queries with a match), n_matches (ids)."""
    n = F.when(F.col("ids") == "", 0).otherwise(F.size(F.split("ids", ",")))
    return lists.agg(F.count("*").alias("n_queries"), F.sum(F.when(n == 0, 1).otherwise(0)).alias("n_singletons"), F.sum(F.when(n > 0, 1).otherwise(0)).alias("n_matched"), F.sum(n).alias("n_matches"))
