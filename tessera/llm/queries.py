"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, lines, neighbours, pages, quality, simhash, suffixes, tokens
from tessera.llm.bpe import Bpe
from tessera.llm.common import table

#: The vocabulary that the queries use.
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer(spark: SparkSession) -> Bpe:
    return Bpe(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("window").cast("long").alias("window_start"), F.round("similarity", 6).alias("similarity"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.by_limit(tokens.histogram(table(spark, sf_dir, "documents"), tokenizer(spark)))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    back = out.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), F.array_join(chat.learnt_texts(F.col("formatted"), F.col("loss_spans")), "").alias("learnt"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("removed_spans").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("+", s["start"], s["length"])), " ").alias("removed_spans"),
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


#: A document is kept if it scores this much at least.
QUALITY = 0.3
#: Rows of labels that are never learnt from.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.model(docs, table(spark, sf_dir, "labels").filter(f"not ({HELD_OUT})"))
    out = docs.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), quality.scored(docs, weights).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= QUALITY).cast("int"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = tokenizer(spark)
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_neighbours": op4_neighbours,
    "op5_html_text": op5_html_text,
    "op6_chat_format": op6_chat_format,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}

def _escaped(text: str) -> str:
    for plain, escaped in chat.ESCAPES:
        text = f"replace({text}, '{plain}', '{escaped}')"
    return text


#: The others are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op6_chat_format": f"""
        with said as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), kept as (
            select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as same from said
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (where role = '{chat.LEARNT}'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = '{chat.LEARNT}'), '')) as loss_sha256,
            sum(length({_escaped("text")}) + case when same then {len(chat.NEXT)} else {len(chat.START + chat.TEXT + chat.END)} + length({_escaped("role")}) end)::bigint as formatted_chars
        from kept group by conv_id
    """,
    "op8_line_dedup": f"""
        with cut as (select doc_id, string_split(regexp_replace(text, '({lines.CLAUSE})', '\\1' || chr(1), 'g'), chr(1)) as parts from documents where text is not null),
        each as (select doc_id, unnest(range(len(parts))) as i, unnest(parts) as part from cut),
        units as (
            select doc_id, i, part, trim(regexp_replace(lower(part), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') as u,
                sum(length(part)) over (partition by doc_id order by i) - length(part) as start
            from each where part <> ''
        ),
        ranked as (
            select *, u = '' or doc_id <> min(doc_id) over (partition by u) or row_number() over (partition by u, doc_id order by i) > 1 as again,
                case when u = '' then 0 else greatest(length(u) - length(replace(u, ' ', '')) + 1, (length(u) + {lines.WORD_CHARS - 1}) // {lines.WORD_CHARS}) end as size
            from units
        ),
        runs as (select *, sum(case when again then 0 else 1 end) over (partition by doc_id order by i) as run from ranked),
        sized as (select *, again and sum(size) filter (where again) over (partition by doc_id, run) >= {lines.MIN_WORDS} as gone from runs),
        spans as (select doc_id, run, min(start) as start, sum(length(part)) as n from sized where gone group by doc_id, run),
        told as (select doc_id, count(*) as n_removed, string_agg(start || '+' || n, ' ' order by start) as removed_spans from spans group by doc_id),
        kept as (select doc_id, coalesce(string_agg(part, '' order by i) filter (where not gone), '') as kept from sized group by doc_id)
        select doc_id, coalesce(n_removed, 0) as n_removed, coalesce(removed_spans, '') as removed_spans,
            case when text is null then null else length(coalesce(kept, '')) end::bigint as kept_chars,
            case when text is null then null else sha256(coalesce(kept, '')) end as kept_sha256
        from documents left join told using (doc_id) left join kept using (doc_id)
    """,
}
