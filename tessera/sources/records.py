"""Record tables: schemas, TSV and Parquet readers and writers, match lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
# What counts as missing in a TSV field, and the headers of both kinds of results.
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>", "-nan", "-NaN", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN", "#N/A N/A"]
MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of a TSV file; doubled quotes are quotes, missing tokens are null. limit: the first rows by id."""
    df = spark.read.schema(RECORD).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.select(*[F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in df.columns])
    return df if limit is None else df.orderBy("entity_id").limit(limit)


def read_ids(df: DataFrame) -> DataFrame:
    return df.select(F.trim("entity_id").alias("entity_id")).filter("entity_id <> ''").distinct()


def source(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def targets(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def id_list(ids: Column) -> Column:
    """array of distinct trimmed ids from a comma list; null and blanks give none."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_match_lists(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, ids from a TSV of two columns."""
    df = spark.read.schema("s1_id string, ids string").option("sep", "\t").option("header", True).csv(path)
    return df.select(F.trim("s1_id").alias("s1_id"), id_list(F.col("ids")).alias("ids"))


def write_match_lists(lists: DataFrame, path: str, header: tuple[str, str] = MATCHES) -> None:
    """lists (s1_id, ids as a comma list) as TSV, empty lists as empty fields."""
    out = lists.select(F.col("s1_id").alias(header[0]), F.col("ids").alias(header[1]))
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_one_file(lists: DataFrame, path: str, header: tuple[str, str] = MATCHES) -> None:
    """lists (s1_id, ids) as one TSV file in order of s1_id. The parts are written and sorted by executors; then their bytes
    follow each other into the file, through a buffer of fixed size."""
    spark, parts = lists.sparkSession, f"{path}.parts"
    out = lists.orderBy("s1_id").select(F.col("s1_id").alias(header[0]), F.col("ids").alias(header[1]))
    out.write.mode("overwrite").option("sep", "\t").option("emptyValue", "").option("nullValue", "").csv(parts)
    jvm = spark._jvm
    to, at = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.create(to, True)
    whole.write(bytearray("\t".join(header) + "\n", "utf-8"))
    # part files are named in the order of the sort
    for each in sorted((x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
        part = files.open(each)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, whole, 1 << 16, False)
        part.close()
    whole.close()
    files.delete(at, True)


def preprocess(df: DataFrame, terms: str = text.ROOT_TERMS) -> DataFrame:
    """df with the derived columns that linking works on."""
    return derived(df, terms).withColumn("src", source(F.col("entity_id")))


def derived(df: DataFrame, terms: str = text.ROOT_TERMS) -> DataFrame:
    """`preprocess` without the source: what depends on names and addresses alone."""
    named = df.withColumn("c_name", text.clean_name(F.col("business_name"))).withColumn("c_addr", text.clean_address(F.col("business_address")))
    return named.withColumns({
        "brand_root": text.brand_root(F.col("c_name"), terms),
        "comp_name": text.compact(F.col("c_name")),
        "numbers": text.numbers(F.col("c_addr"), distinct=False),
        "postals": text.postals(F.col("c_addr")),
        "len_name": F.length("c_name").cast("float"),
        "len_addr": F.length("c_addr").cast("float"),
    })


def write_cache(df: DataFrame, path: str) -> None:
    """Preprocessed records by country; a later write of some countries replaces those alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def preprocess_all(spark: SparkSession, data_dir: str, path: str, parts: tuple[str, ...] = ("train", "test"), sources: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    """The caches of all parts, each in a folder of its own, from {part}_source{k}.tsv; missing files are skipped. The
    parts that were written."""
    done = []
    for part in parts:
        found = []
        for k in sources:
            name = f"{data_dir.rstrip('/')}/{part}_source{k}.tsv"
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                found.append(read_records(spark, name))
        if found:
            write_cache(preprocess(targets(*found)), f"{path.rstrip('/')}/{part}")
            done.append(part)
    return done


def countries(df: DataFrame) -> DataFrame:
    """The distinct countries."""
    return df.select("country").distinct()


def load_cache(spark: SparkSession, path: str, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The S1 records and all others; a country prunes partitions."""
    df = spark.read.parquet(path)
    if country is not None:
        df = df.filter(F.col("country") == country)
    return df.filter("src = 'S1'"), df.filter("src <> 'S1'")
