"""Record tables made from the tables of a test directory, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Whole documents as records of four countries, with real copies: the first line as name, all the rest as address.
DOCS = """select 'S' || cast(1 + doc_id % 3 as string) || '-' || cast(doc_id as string) as entity_id, split_part(text, chr(10), 1) as business_name,
    substring(text, length(split_part(text, chr(10), 1)) + 2) as business_address, lang as country from {documents}"""

_BASE = """select p_partkey as g, p_name || ' ' || p_type as base, p_brand as brand,
    case p_partkey % 4 when 0 then 'US' when 1 then 'India' when 2 then 'France' else 'Germany' end as country,
    cast(p_partkey % 200 + 1 as string) as n, cast(p_partkey % 200 + 2 as string) as n1, cast(p_partkey % 40 as string) as sector,
    cast(110000 + p_partkey % 500 as string) as pin, cast(110001 + p_partkey % 500 as string) as pin1 from {part}"""

#: Parties with known matches, numbers and postal codes.
PARTIES = f"""with b as ({_BASE}), r as (
    select 'S1-' || cast(g as string) as entity_id, base || ' Ltd.' as name, n || ' ' || brand || ' Street, Sector ' || sector || ', ' || pin as address, country from b
    union all select 'S2-' || cast(g as string), replace(base, 'i', 'y') || ' Pvt Ltd', case when g % 7 <> 0 then n || ' ' || brand || ' St, Sector ' || sector || ', ' || pin end, country from b where g % 5 <> 0
    union all select 'S3-' || cast(g as string), replace(base, ' ', '') || '.com', case when g % 11 = 0 then n1 else n end || ' ' || brand || ' Street, Sector ' || sector, country from b where g % 4 <> 0
    union all select 'S3-' || cast(g as string) || '-alt', upper(base), n || ' ' || brand || ' Street, Sector ' || sector || ', ' || pin1, country from b where g % 6 = 0)
    select entity_id, case when country = 'France' then replace(name, 'e', 'é') else name end as business_name, address as business_address, country from r"""

#: Which of the parties match.
PARTY_TRUTH = """select 'S1-' || cast(p_partkey as string) as s1_id, 'S2-' || cast(p_partkey as string) as tgt_id from {part} where p_partkey % 5 <> 0
    union all select 'S1-' || cast(p_partkey as string), 'S3-' || cast(p_partkey as string) from {part} where p_partkey % 4 <> 0"""

PAGES = "select 'S1-' || cast(page_id as string) as entity_id, url as business_name, '' as business_address, 'web' as country from {pages}"

NATIONS = """select 'S1-' || cast(c_custkey as string) as entity_id, c_name as business_name, cast(c_custkey as string) || ' ' || c_name || ' Rd, #' || cast(c_nationkey as string) as business_address, n_name as country from {customer} join {nation} on c_nationkey = n_nationkey
    union all select 'S2-' || cast(s_suppkey as string), s_name, cast(s_suppkey as string) || ' ' || s_name || ' Ave', n_name from {supplier} join {nation} on s_nationkey = n_nationkey"""

#: Lines of orders as truth and as scored predictions.
ORDER_TRUTH = "select distinct l_orderkey as s1_id, l_partkey as tgt_id from {lineitem} where l_returnflag = 'R'"
ORDER_SCORED = "select l_orderkey as s1_id, l_partkey as tgt_id, max(cast(round(l_discount * 100) as int)) as score from {lineitem} group by l_orderkey, l_partkey"
ORDER_KEYS = "select distinct l_orderkey as s1_id from {lineitem}"

TABLES = ("documents", "part", "pages", "customer", "supplier", "nation", "lineitem", "orders", "labels")


#: Few bytes that turn into much work: their rows are dealt out before it.
SMALL = ("part",)


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: _spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")) if t in SMALL else spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same for an engine that has the tables by name."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql
