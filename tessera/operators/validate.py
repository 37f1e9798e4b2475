"""Checks of a result file against its contract: rows (rule, severity, n, examples).

Lines of a file come as (line, value); rules are V2 to V12 as in the design notes. Offenders are counted where they are,
and only five examples of each rule are gathered.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.records import CANDIDATES, MATCHES


def parsed(lines: DataFrame) -> DataFrame:
    """s1_id, ids (comma list as written) from (line, value) after the header; lines without a tab are malformed."""
    parts = F.split("value", "\t", 2)
    return lines.filter("trim(value) <> ''").select("line", F.col("value").contains("\t").alias("has_tab"), F.trim(F.get(parts, F.lit(0))).alias("s1_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("ids"))


def entries(rows: DataFrame) -> DataFrame:
    """s1_id, tgt_id of all lists, one row for each entry; ids are not trimmed."""
    return rows.filter("ids <> ''").select("s1_id", F.explode(F.split("ids", ",")).alias("tgt_id")).filter("tgt_id <> ''")


def _offenders(rule: str, ids: DataFrame, severity: str = "error") -> DataFrame:
    return ids.toDF("id").select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "id")


def violations(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """rule, severity, id of everything that breaks a rule. rows (has_tab, s1_id, ids); required (s1_id); known (tgt_id)
    switches the id check on; candidates are rows of the other file."""
    good = rows.filter("has_tab")
    listed = entries(good)
    out = [
        _offenders("V4", rows.filter("not has_tab").select(F.col("line").cast("string"))) if "line" in rows.columns else None,
        _offenders("V5", good.groupBy("s1_id").agg(F.count("*").alias("n")).filter("n > 1").select("s1_id")),
        _offenders("V6", listed.groupBy("s1_id", "tgt_id").agg(F.count("*").alias("n")).filter("n > 1").select("s1_id").distinct()),
        _offenders("V7", listed.filter("tgt_id like 'S1-%'").select("tgt_id").distinct()),
        _offenders("V8", listed.filter("not (tgt_id like 'S1-%' or tgt_id like 'S2-%' or tgt_id like 'S3-%')").select("tgt_id").distinct()),
        _offenders("V9", listed.filter("tgt_id like 'S2-%' or tgt_id like 'S3-%'").join(known, "tgt_id", "left_anti").select("tgt_id").distinct()) if known is not None else None,
        _offenders("V10", required.join(good, "s1_id", "left_anti").select("s1_id").distinct()),
        _offenders("V11", good.join(required, "s1_id", "left_anti").select("s1_id").distinct()),
        _offenders("V12", listed.join(entries(candidates.filter("has_tab")), ["s1_id", "tgt_id"], "left_anti").select("s1_id").distinct(), "warning") if candidates is not None else None,
    ]
    found = [x for x in out if x is not None]
    result = found[0]
    for x in found[1:]:
        result = result.unionByName(x)
    return result


def report(found: DataFrame, n_examples: int = 5) -> DataFrame:
    """rule, severity, n, examples: how many offend, and the first by name."""
    from pyspark.sql import Window

    first = found.withColumn("rk", F.row_number().over(Window.partitionBy("rule").orderBy("id"))).filter(F.col("rk") <= n_examples)
    examples = first.groupBy("rule", "severity").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return found.groupBy("rule").agg(F.count("*").alias("n")).join(examples, "rule").select("rule", "severity", "n", "examples")


def header_problem(header: str | None, kind: tuple[str, str] = MATCHES) -> str | None:
    """V1 to V3 on a file's first line: what is wrong, or None."""
    if header is None or not header.strip():
        return "V1"
    if "\t" not in header and "," in header:
        return "V2"
    return None if tuple(x.strip().lower() for x in header.rstrip("\r\n").split("\t")) == kind else "V3"


def validate_files(spark: SparkSession, matches: str, candidates: str, required: DataFrame, known: DataFrame | None = None) -> tuple[int, DataFrame | None]:
    """0 or 1 as an exit code, and the report; a bad file or header ends it at once. Warnings never fail."""
    both = []
    broken = None
    for path, kind in ((matches, MATCHES), (candidates, CANDIDATES)):
        try:
            text = spark.read.text(path)
            header = next(iter(x.value for x in text.limit(1).collect()), None)
        except AnalysisException:  # a missing file is a finding, not a crash
            return 1, None
        if header_problem(header, kind):
            return 1, None
        # lines are raw bytes to the reader; what is no UTF-8 is counted, with the file
        bad = text.filter(~F.is_valid_utf8("value")).select(F.lit("V13").alias("rule"), F.lit("error").alias("severity"), F.concat_ws(":", F.lit(kind[1]), F.hex(F.substring(F.col("value").cast("binary"), 1, 40))).alias("id"))
        broken = bad if broken is None else broken.unionByName(bad)
        # one line of each file is its header; lines that repeat it are rows
        headers = text.filter(F.col("value") == header).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
        again = spark.range(headers.agg(F.sum(F.col("n") - 1)).first()[0]).select(F.lit(header).alias("value"))
        both.append(parsed(text.filter(F.col("value") != header).unionByName(again).withColumn("line", F.monotonically_increasing_id())))
    told = report(violations(both[0], required, known, both[1]).unionByName(violations(both[1], required, known)).unionByName(broken))
    return int(bool(told.filter("severity = 'error'").limit(1).count())), told


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
