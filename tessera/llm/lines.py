"""Substring dedup by hashing lines and what they are made of.

Texts are cut into units at line ends and after sentence and clause marks, as repeated passages begin and end inside
lines; `cut` may be `LINE` or `PARAGRAPH` instead. Units are normalised (lower case, white space runs as one space,
trimmed) and digested to 64 bits. Digests are grouped over all documents; of each the occurrence in the document of
the least doc_id stays, there the first. The others are repeated, and runs of neighbouring repeated units go if they
have `min_words` words or more, so that what common phrases share by chance stays; with 1, every repeated unit goes. A
unit counts as one word for each eight characters if it has fewer, so that scripts without spaces take part. Blank
units go with the run around them. A chance collision of digests does harm only inside a run of repeated units.

A document tells each of its digests once, whether or not it repeats there; rows of digest and id are pre-aggregated
before they are shuffled, and the join of a digest that many documents share is split by Spark.

Null texts count as empty and stay null. Rows that share an id are one document: they lose nothing to each other. Rows
without an id rank last, by the hash of their text. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, forget, fresh

#: Words of a run of repeated units from which it goes.
MIN_WORDS = 30
#: Characters that count as a word at least.
WORD_CHARS = 8
#: What ends units.
LINE, PARAGRAPH, CLAUSE = r"\n", r"\n\n", r"\n|[.!?,;:][ \t]|[。！？；，、：]"
_BLANKS = re.compile(r"[ \t\n\r\f]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("length", T.IntegerType(), False)]), False)


def units(text: str, cut: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """start, end and normalised text of each unit; together they are the whole text."""
    start = 0
    for m in cut.finditer(text):
        yield start, m.end(), _BLANKS.sub(" ", text[start : m.end()].lower()).strip(" ")
        start = m.end()
    if start < len(text):
        yield start, len(text), _BLANKS.sub(" ", text[start:].lower()).strip(" ")


def digest(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(unit)


def repeated_runs(text: str, cut: re.Pattern, min_words: int, elsewhere: set[int], again: set[int]) -> list[tuple[int, int]]:
    """(start, length) of the runs that go. elsewhere: digests that an earlier document has; again: those of which only
    the first stays."""
    out: list[tuple[int, int]] = []
    seen: set[int] = set()
    first, end, size = -1, -1, 0
    for a, b, u in units(text, cut):
        if u:
            d = digest(u)
            gone = d in elsewhere or d in seen
            if d in again:
                seen.add(d)
        if not u or gone:
            first = a if first < 0 else first
            end, size = b, size + (max(u.count(" ") + 1, -(-len(u) // WORD_CHARS)) if u else 0)
        elif first >= 0:
            if size >= min_words:
                out.append((first, end - first))
            first, size = -1, 0
    if first >= 0 and size >= min_words:
        out.append((first, end - first))
    return out


def _digests(docs: DataFrame, cut: str) -> DataFrame:
    """doc_id, h, d, again: the digests of each text (doc_id, h, t), and whether it has them more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pattern = re.compile(cut)
        for b in batches:
            rows: list[int] = []
            found: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            held = 0
            texts = b.column("t")
            for i in range(b.num_rows):
                if texts[i].is_valid:
                    d, n = np.unique(np.array([digest(u) for _, _, u in units(texts[i].as_py(), pattern) if u], np.uint64), return_counts=True)
                    rows.append(i)
                    found.append(d)
                    counts.append(n)
                    held += len(d)
                if rows and (held > 100_000 or i == b.num_rows - 1):
                    who = np.repeat(rows, [len(d) for d in found])
                    d, n = np.concatenate(found).view(np.int64), np.concatenate(counts)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who)), b.column("h").take(pa.array(who)), pa.array(d), pa.array(n > 1)], names=["doc_id", "h", "d", "again"])
                    rows, found, counts, held = [], [], [], 0

    schema = T.StructType([docs.schema["doc_id"], docs.schema["h"], T.StructField("d", T.LongType(), False), T.StructField("again", T.BooleanType(), False)])
    return docs.select("doc_id", "h", "t").mapInArrow(run, schema)


def repeated_digests(df: DataFrame, text: str = "text", doc_id: str = "doc_id", cut: str = CLAUSE) -> DataFrame:
    """doc_id, h (a hash of the text), elsewhere, again: digests of each document that an earlier one has, and digests
    that it has more than once itself. Only documents with any."""
    scratch = Scratch(df.sparkSession, "lines")
    rows = scratch.save(_digests(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t")), cut))
    # plain columns, as structs would be sorted to be aggregated
    least = rows.groupBy("d").agg(F.min("doc_id").alias("first_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("h"))).alias("first_h"), F.count("*").alias("c"))
    # written, so that the join stands alone on its exchanges and Spark can split a digest that many documents have
    first = scratch.save(least.filter("c > 1").drop("c"))
    later = rows.drop("again").join(first, "d").filter(F.when(F.col("first_id").isNull(), F.col("h") != F.col("first_h")).otherwise(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_id"))))
    marks = later.select("doc_id", "h", "d", F.lit(True).alias("later")).unionByName(rows.filter("again").select("doc_id", "h", "d", F.lit(False).alias("later")))
    lists = marks.groupBy("doc_id", "h").agg(F.collect_set(F.when(F.col("later"), F.col("d"))).alias("elsewhere"), F.collect_set(F.when(~F.col("later"), F.col("d"))).alias("again"))
    out = scratch.save(lists)
    scratch.drop(rows)
    scratch.drop(first)
    return out


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", cut: str = CLAUSE, min_words: int = MIN_WORDS, spans: str = "removed_spans") -> DataFrame:
    """df with the runs taken out of its texts, and in place of any column `spans` an array of (start, length) in code
    points of the original text, which tells what went."""
    if spans in (text, doc_id):
        raise ValueError(f"{spans} is a column that is read")
    base = df.drop(spans)
    rid, rh, elsewhere, again, done = fresh(base, "repeat_id", "repeat_h", "elsewhere", "again", "done")
    found = repeated_digests(df, text, doc_id, cut).toDF(rid, rh, elsewhere, again)

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS, False)]))
    def removed(texts: pa.Array, wholly: pa.Array, partly: pa.Array) -> pa.Array:
        forget()
        pattern = re.compile(cut)
        kept, gone = [], []
        for t, w, p in zip(texts, wholly, partly, strict=True):
            t, runs = t.as_py(), []
            if t is not None and w.is_valid:
                runs = repeated_runs(t, pattern, min_words, *({x & 0xFFFFFFFFFFFFFFFF for x in s.as_py()} for s in (w, p)))
                ends = [0, *(a + n for a, n in runs)]
                t = "".join(t[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(t)], strict=True)) if runs else t
            kept.append(t)
            gone.append([{"start": a, "length": n} for a, n in runs])
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], names=["text", "spans"])

    both = base.join(found, F.col(doc_id).eqNullSafe(F.col(rid)) & (F.xxhash64(text) == F.col(rh)), "left")
    both = both.withColumn(done, removed(F.col(text), F.col(elsewhere), F.col(again)))
    return both.select(*[F.col(f"{done}.text").alias(text) if c == text else F.col(f"`{c}`") for c in base.columns], F.col(f"{done}.spans").alias(spans))
