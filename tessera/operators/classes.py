"""Records of equal texts as one class: what depends on texts alone is worked out once for each class, then handed to its
records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch, apart


#: Ids of a class that one row holds, as they are hashed.
HELD = 256


def of(records: DataFrame, columns: list[str], scratch: Scratch, raw: list[str] | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The classes (class, columns, n) and their records (class, entity_id), one row for each record. Nulls are equal.
    made: gives records with `raw` the columns, from these alone; it is run once for records of the same."""
    if made is not None:
        first, members = of(records, raw, scratch)
        each = scratch.save(made(first).select(F.col("class").alias("first"), *columns, F.col("n").alias("many")))
        texts = scratch.save(each.groupBy(*columns).agg(F.sum("many").alias("n")).withColumn("class", F.monotonically_increasing_id()))
        number = each.join(apart(texts), _same(each, texts, columns)).select("first", texts["class"].alias("now"))
        return texts, members.join(apart(number), F.col("class") == F.col("first")).select(F.col("now").alias("class"), "entity_id")
    rows = scratch.save(records.select("entity_id", *columns))
    # numbered once, as they are written
    texts = scratch.save(rows.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    return texts, rows.join(apart(texts), _same(rows, texts, columns)).select("class", "entity_id")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    same: Column = F.lit(True)
    for c in columns:
        same &= a[c].eqNullSafe(b[c])
    return same


def lists(texts: DataFrame, members: DataFrame) -> DataFrame:
    """class, ids: the records of each class, some HELD in a row, so that a pair of classes turns into its pairs of records
    without a row of a join for each."""
    parts = members.join(apart(texts.select("class", "n")), "class")
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("n") / HELD)).alias("part")
    return parts.groupBy("class", part).agg(F.collect_list("entity_id").alias("ids")).select("class", "ids")
