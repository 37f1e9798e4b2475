"""The engine's queries over a test directory, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import blocking, decide, features, metrics, model, sampling, validate
from tessera.operators.blocking import PROFILES, Profile
from tessera.plans import oracle
from tessera.sources import records, testbeds
from tessera.sources.scratch import Scratch, apart
from tessera.sources.testbeds import load, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS, PARTIES = plain(testbeds.DOCS), plain(testbeds.PARTIES)
TRUTH = plain(testbeds.PARTY_TRUTH)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parties' S1 records and the others, preprocessed."""
    df = records.preprocess(load(spark, sf_dir, testbeds.PARTIES))
    return df.filter("src = 'S1'"), df.filter("src <> 'S1'")


def truth_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, testbeds.PARTY_TRUTH)


# normalisation

NORM_DOCS, NORM_PARTIES = f"with {oracle.normalised(DOCS)}", f"with {oracle.normalised(PARTIES)}"
SORTED = lambda c: F.array_join(F.array_sort(c), " ")


@query("norm_name", f"{NORM_DOCS} select entity_id, c_name from norm")
def norm_name(spark, d):
    return load(spark, d, testbeds.DOCS).select("entity_id", text.clean_name(F.col("business_name")).alias("c_name"))


@query("norm_name_wide", f"with {oracle.normalised(PARTIES, text.LEGAL_WIDE, text.TLD_WIDE)} select entity_id, c_name from norm")
def norm_name_wide(spark, d):
    return load(spark, d, testbeds.PARTIES).select("entity_id", text.clean_name(F.col("business_name"), text.LEGAL_WIDE, text.TLD_WIDE).alias("c_name"))


@query("norm_url_name", f"with {oracle.normalised(plain(testbeds.PAGES))} select entity_id, c_name from norm")
def norm_url_name(spark, d):
    return load(spark, d, testbeds.PAGES).select("entity_id", text.clean_name(F.col("business_name")).alias("c_name"))


@query("norm_address", f"with {oracle.normalised(plain(testbeds.NATIONS))} select entity_id, c_addr from norm")
def norm_address(spark, d):
    return load(spark, d, testbeds.NATIONS).select("entity_id", text.clean_address(F.col("business_address")).alias("c_addr"))


@query("norm_fold", f"select entity_id, {oracle.fold('business_name')} as folded from ({DOCS})")
def norm_fold(spark, d):
    return load(spark, d, testbeds.DOCS).select("entity_id", text.fold(F.coalesce("business_name", F.lit(""))).alias("folded"))


@query("numbers_postals", f"{NORM_PARTIES} select entity_id, array_to_string(numbers, ' ') as numbers, array_to_string(list_sort(list_distinct(numbers)), ' ') as number_set, array_to_string(list_sort(postals), ' ') as postals from norm")
def numbers_postals(spark, d):
    df = records.preprocess(load(spark, d, testbeds.PARTIES))
    return df.select("entity_id", F.array_join("numbers", " ").alias("numbers"), SORTED(F.array_distinct("numbers")).alias("number_set"), SORTED(F.col("postals")).alias("postals"))


@query("brand_root", f"{NORM_PARTIES} select entity_id, brand_root from norm")
def brand_root(spark, d):
    return records.preprocess(load(spark, d, testbeds.PARTIES)).select("entity_id", "brand_root")


@query("brand_root_wide", f"with {oracle.normalised(PARTIES, terms=text.ROOT_TERMS_WIDE)} select entity_id, brand_root from norm")
def brand_root_wide(spark, d):
    return records.preprocess(load(spark, d, testbeds.PARTIES), text.ROOT_TERMS_WIDE).select("entity_id", "brand_root")


@query("compact_name", f"{NORM_PARTIES} select entity_id, comp_name from norm")
def compact_name(spark, d):
    return records.preprocess(load(spark, d, testbeds.PARTIES)).select("entity_id", "comp_name")


@query("plain_clean", f"select entity_id, coalesce(array_to_string({oracle.tokens('''regexp_replace(lower(coalesce(business_name, '')), '[^a-z0-9\\s]', ' ', 'g')''')}, ' '), '') as cleaned from ({PARTIES})")
def plain_clean(spark, d):
    return load(spark, d, testbeds.PARTIES).select("entity_id", text.plain_clean(F.col("business_name")).alias("cleaned"))


@query("preprocess_cache", f"{NORM_PARTIES} select entity_id, country, src, c_name, c_addr, brand_root, comp_name, array_to_string(numbers, ' ') as numbers, array_to_string(list_sort(postals), ' ') as postals, length(c_name)::double as len_name, length(c_addr)::double as len_addr from norm")
def preprocess_cache(spark, d):
    df = records.preprocess(load(spark, d, testbeds.PARTIES))
    return df.select("entity_id", "country", "src", "c_name", "c_addr", "brand_root", "comp_name", F.array_join("numbers", " ").alias("numbers"), SORTED(F.col("postals")).alias("postals"), F.col("len_name").cast("double").alias("len_name"), F.col("len_addr").cast("double").alias("len_addr"))


def _gram_query(name: str, column: str, short: bool) -> None:
    sql = f"{NORM_DOCS} select entity_id, len({oracle._grams(column, short)})::bigint as n, array_to_string(list_sort({oracle._grams(column, short)}), '|') as grams from norm"

    @query(name, sql)
    def grams(spark, d):
        df = records.preprocess(load(spark, d, testbeds.DOCS)).withColumn("g", text.char_ngrams(F.col(column), short="whole" if short else "none"))
        return df.select("entity_id", F.size("g").cast("long").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


_gram_query("char_ngrams_compact", "comp_name", True)
_gram_query("char_ngrams_raw", "c_name", False)
_gram_query("char_ngrams_raw_whole", "c_name", True)


@query("doc_frequency", f"{NORM_DOCS}, t as (select country, unnest(list_distinct([t for t in name_tokens if length(t) >= 3])) as token from norm where src <> 'S1') select country, token, count(*) as df, round(1.5 / (1 + ln(1 + count(*)::double)), 6) as weight from t group by all")
def doc_frequency(spark, d):
    df = records.preprocess(load(spark, d, testbeds.DOCS)).filter("src <> 'S1'")
    words = df.select("country", F.explode(F.array_distinct(F.filter(text.tokens(F.col("c_name")), lambda t: F.length(t) >= 3))).alias("token"))
    out = words.groupBy("country", "token").agg(F.count("*").alias("df"))
    return out.withColumn("weight", F.round(1.5 / (1 + F.log(1 + F.col("df").cast("double"))), 6))


@query("source_ids", f"select distinct trim(entity_id) as entity_id, substring(entity_id, 1, 2) as src, (entity_id like 'S3-%')::int as is_s3 from ({PARTIES})")
def source_ids(spark, d):
    ids = records.read_ids(load(spark, d, testbeds.PARTIES))
    return ids.select("entity_id", records.source(F.col("entity_id")).alias("src"), F.col("entity_id").startswith("S3-").cast("int").alias("is_s3"))


@query("countries", f"select distinct country from ({PARTIES})")
def countries(spark, d):
    return records.countries(load(spark, d, testbeds.PARTIES))


@query("target_union", f"select country, substring(entity_id, 1, 2) as src, count(*) as n from ({PARTIES}) where entity_id not like 'S1-%' group by all")
def target_union(spark, d):
    df = load(spark, d, testbeds.PARTIES)
    return records.targets(df.filter("entity_id like 'S2-%'"), df.filter("entity_id like 'S3-%'")).groupBy("country", records.source(F.col("entity_id")).alias("src")).agg(F.count("*").alias("n"))


# candidate generation


def _block(name: str, profile: Profile, bed: str) -> None:
    @query(name, f"with {oracle.candidates(plain(bed), profile)} select * from cand")
    def block(spark, d):
        df = records.preprocess(load(spark, d, bed))
        return blocking.candidates(df.filter("src = 'S1'"), df.filter("src <> 'S1'"), profile)


for _channel, _key in {"exact": "exact", "prefix2": "prefix2", "compact": "compact", "root": "root", "token": "token_idf", "char3": "char3", "number": "num_locality"}.items():
    _block(f"block_{_key}", Profile(_channel, {_channel: PROFILES["v4" if _channel == "root" else "v3"].channels[_channel]}, 25), testbeds.PARTIES)
for _name in PROFILES:
    _block(f"block_multi_{_name}", PROFILES[_name], testbeds.PARTIES)
_block("block_docs_v3fast", PROFILES["v3fast"], testbeds.DOCS)
_block("block_nations_v6", PROFILES["v6"], testbeds.NATIONS)

V6 = oracle.candidates(PARTIES, PROFILES["v6"])


@query("blocking_report", f"""with {V6}, tr as ({TRUTH}), c as (select count(*) as n_true, count(cand.s1_id) as n_captured from tr left join cand using (s1_id, tgt_id)), k as (select count(*) as n_candidates from cand),
    s as (select count(*) filter (where src = 'S1') as q, count(*) filter (where src <> 'S1') as t from norm)
    select n_true, n_captured, n_candidates, round(100.0 * n_captured / n_true, 6)::double as recall_ceiling, round(n_candidates / q, 6)::double as avg_candidates, round(100.0 * (1 - n_candidates / (q::double * t)), 6)::double as reduction_ratio from c, k, s""")
def blocking_report(spark, d):
    s1, tgt = parties(spark, d)
    out = metrics.blocking_report(s1, tgt, blocking.candidates(s1, tgt, PROFILES["v6"]), truth_of(spark, d))
    return out.select("n_true", "n_captured", "n_candidates", *[F.round(c, 6).alias(c) for c in ("recall_ceiling", "avg_candidates", "reduction_ratio")])


@query("tfidf_cosine", f"""{NORM_DOCS},
    w as (select country, entity_id as id, ' ' || unnest([t for t in string_split_regex(c_name || ' ' || c_addr, '\\s+') if t <> '']) || ' ' as w from norm),
    g as (select country, id, unnest(case when length(w) > 3 then list_concat([substring(w, i::bigint, 3) for i in range(1, length(w) - 1)], [substring(w, i::bigint, 4) for i in range(1, length(w) - 2)]) else [w] end) as g from w),
    tf as (select country, id, g, count(*) as tf from g group by all), n as (select country, count(*) as n from norm group by all),
    df as (select country, g, count(*) as df from tf group by all having count(*) >= 2),
    x as (select country, id, g, tf * (ln((1 + n) / (1 + df)::double) + 1) as x from tf join df using (country, g) join n using (country)),
    l as (select country, id, sqrt(sum(x * x)) as l from x group by all), u as (select country, id, g, x / l as x from x join l using (country, id)),
    dots as (select a.id as s1_id, b.id as tgt_id, sum(a.x * b.x) as c from u a join u b using (country, g) where a.id like 'S1-%' and b.id not like 'S1-%' group by all having sum(a.x * b.x) > 0.15)
    select s1_id, tgt_id, round(c, 6) as cosine, row_number() over (partition by s1_id order by round(c, 9) desc, tgt_id)::int as rank from dots qualify rank <= 20""")
def tfidf_cosine(spark, d):
    df = records.preprocess(load(spark, d, testbeds.DOCS))
    return blocking.tfidf_cosine(df.filter("src = 'S1'"), df.filter("src <> 'S1'"))


def _tier(key: str, where: str, scores: tuple[str, ...]) -> str:
    """First-tier hits by equal `key`, with addresses held against each other."""
    conflict = "(len(ap) > 0 and len(bp) > 0 and len(list_intersect(ap, bp)) = 0) or (len(anum) > 0 and len(bnum) > 0 and len(list_intersect(anum, bnum)) = 0 and ratio.r < 70)"
    common = f"case when len(list_intersect(ap, bp)) > 0 then {scores[1]} when len(list_intersect(anum, bnum)) > 0 and ts >= 60 then {scores[2]} when ts >= 75 then {scores[3]} end"
    return f"select s1_id, tgt_id, case when n_hits > 3 then {common} when not ({conflict}) then {scores[0]} end::double as score from hits join ratio on aa = ratio.a and ba = ratio.b join token_set on aa = token_set.a and ba = token_set.b where k = '{key}' and {where}"


_HITS = lambda key, least: f"select '{key}' as k, a.entity_id as s1_id, b.entity_id as tgt_id, a.c_name as an, b.c_name as bn, a.c_addr as aa, b.c_addr as ba, a.numbers as anum, b.numbers as bnum, a.postals as ap, b.postals as bp, count(*) over (partition by a.entity_id) as n_hits from norm a join norm b on a.country = b.country and a.{key} = b.{key} where a.src = 'S1' and b.src <> 'S1' and length(a.{key}) >= {least}"
CASCADE = f"""hits as ({_HITS("c_name", 1)} union all {_HITS("comp_name", 5)}), {oracle.token_sets("select distinct aa as a, ba as b from hits")},
    casc as (select * from ({_tier("c_name", "true", ("1.0", "0.95", "0.90", "0.85"))} union all {_tier("comp_name", "an <> bn", ("0.98", "0.92", "0.88", "0.82"))}) where score is not null)"""


@query("cascade_v2", f"with recursive {oracle.normalised(PARTIES)}, {CASCADE} select s1_id, tgt_id, score from casc")
def cascade_v2(spark, d):
    df = load(spark, d, testbeds.PARTIES).withColumn("src", records.source(F.col("entity_id")))
    return blocking.cascade(df.filter("src = 'S1'"), df.filter("src <> 'S1'"), records.derived)


@query("cascade_tier2", f"with recursive {oracle.candidates(PARTIES, PROFILES['v2'])}, {CASCADE} select s1_id, tgt_id, score, rank from cand where s1_id not in (select s1_id from casc)")
def cascade_tier2(spark, d):
    s1, tgt = parties(spark, d)
    return blocking.second_tier(s1, tgt)


# similarities and features

PAIRS = f"{V6}, pr as (select s1_id, tgt_id, a.c_name as an, b.c_name as bn, a.c_addr as aa, b.c_addr as ba, a.numbers as anum, b.numbers as bnum, a.postals as ap, b.postals as bp, a.comp_name as ac, b.comp_name as bc, a.brand_root as ar, b.brand_root as br from cand join norm a on a.entity_id = s1_id join norm b on b.entity_id = tgt_id)"


def all_pairs(spark, d) -> DataFrame:
    """All candidates of the profile."""
    s1, tgt = parties(spark, d)
    return features.pairs(blocking.candidates(s1, tgt, PROFILES["v6"]).select("s1_id", "tgt_id"), s1, tgt)


@query("sim_ratio", f"with recursive {PAIRS}, {oracle.ratios('select distinct an as a, bn as b from pr')} select s1_id, tgt_id, round(r, 6)::double as ratio from pr join ratio on an = a and bn = b")
def sim_ratio(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["ratio"]))
    return df.select("s1_id", "tgt_id", F.round("s.ratio", 6).alias("ratio"))


_SORT = "array_to_string(list_sort([t for t in string_split_regex({}, '\\s+') if t <> '']), ' ')"


@query("sim_token_sort", f"with recursive {PAIRS}, so as (select s1_id, tgt_id, {_SORT.format('an')} as sa, {_SORT.format('bn')} as sb from pr), {oracle.ratios('select distinct sa as a, sb as b from so')} select s1_id, tgt_id, round(r, 6)::double as token_sort from so join ratio on sa = a and sb = b")
def sim_token_sort(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["token_sort"]))
    return df.select("s1_id", "tgt_id", F.round("s.token_sort", 6).alias("token_sort"))


@query("sim_token_set", f"with recursive {PAIRS}, {oracle.token_sets('select distinct an as a, bn as b from pr')} select s1_id, tgt_id, round(ts, 6)::double as token_set from pr join token_set on an = a and bn = b")
def sim_token_set(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["token_set"]))
    return df.select("s1_id", "tgt_id", F.round("s.token_set", 6).alias("token_set"))


@query("sim_jaro_winkler", f"with {PAIRS} select s1_id, tgt_id, round(jaro_winkler_similarity(an, bn), 6) as jw from pr")
def sim_jaro_winkler(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["jaro_winkler"]))
    return df.select("s1_id", "tgt_id", F.round("s.jaro_winkler", 6).alias("jw"))


@query("sim_kernels")
def sim_kernels(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), list(similarity.KERNELS)))
    return df.select("s1_id", "tgt_id", "s.*")


_JACCARD = lambda a, b, e: f"case when len(list_distinct(list_concat({a}, {b}))) = 0 then 0.0 else len(list_intersect({a}, {b})) / (len(list_distinct(list_concat({a}, {b}))) + {e})::double end"


@query("jaccard_char3", f"with {PAIRS}, gr as (select s1_id, tgt_id, {oracle._grams('an', False)} as g, {oracle._grams('bn', False)} as h from pr) select s1_id, tgt_id, round({_JACCARD('g', 'h', '1e-5')}, 6)::double as jaccard from gr")
def jaccard_char3(spark, d):
    return all_pairs(spark, d).select("s1_id", "tgt_id", F.round(similarity.jaccard(text.char_ngrams(F.col("a_c_name")), text.char_ngrams(F.col("b_c_name")), 1e-5), 6).alias("jaccard"))


_TRIPLES = {"compact": oracle._grams("{0}c", True), "raw": oracle._grams("{0}n", False), "raw_whole": oracle._grams("{0}n", True)}
_ALIKE = {k: f"case when len({g.format('a')}) > 0 and len({g.format('b')}) > 0 then {_JACCARD(g.format('a'), g.format('b'), '1e-5')} else 0.0 end" for k, g in _TRIPLES.items()}


@query("gram_variants", f"with {PAIRS} select s1_id, tgt_id, " + ", ".join(f"round({v}, 6)::double as {k}" for k, v in _ALIKE.items()) + " from pr")
def gram_variants(spark, d):
    """The letter triples of the generations, as the 37 features compare them."""
    out = None
    for kind in _TRIPLES:
        each = features.features(all_pairs(spark, d), "p4", grams=kind).select("s1_id", "tgt_id", F.round("name_char_jaccard_3gram", 6).alias(kind))
        out = each if out is None else out.join(each, ["s1_id", "tgt_id"])
    return out


@query("num_jaccard", f"with {PAIRS} select s1_id, tgt_id, len(list_intersect(anum, bnum))::bigint as common, round({_JACCARD('anum', 'bnum', '0')}, 6)::double as jaccard from pr")
def num_jaccard(spark, d):
    return all_pairs(spark, d).select("s1_id", "tgt_id", F.size(F.array_intersect("a_numbers", "b_numbers")).cast("long").alias("common"), F.round(similarity.jaccard(F.col("a_numbers"), F.col("b_numbers")), 6).alias("jaccard"))


for _kind, _name in {"p1": "features17", "p2": "features28", "p3": "features28_fast", "p4": "features37"}.items():
    QUERIES[_name] = lambda spark, d, k=_kind: features.features(all_pairs(spark, d), k)

_ON = "aa <> '' and ba <> ''"
_PARTS = {
    "name_exact_match": "(an = bn)::int::double", "name_len_diff": "abs(length(an) - length(bn))::double", "name_len_ratio": "case when greatest(length(an), length(bn)) > 0 then least(length(an), length(bn)) / greatest(length(an), length(bn))::double else 1.0 end",
    "compact_exact": "(ac = bc and ac <> '')::int::double", "addr_is_missing": f"(not ({_ON}))::int::double", "addr_first_token_match": f"case when {_ON} then (substring(aa, 1, 6) = substring(ba, 1, 6))::int::double else 0.0 end",
    "num_common_count": f"case when {_ON} then len(list_intersect(anum, bnum))::double else 0.0 end", "num_mismatch_penalty": f"case when {_ON} and len(anum) > 0 and len(bnum) > 0 then case when len(list_intersect(anum, bnum)) > 0 then 1.0 else -1.0 end else 0.0 end::double",
    "pin_exact_match": f"case when {_ON} and len(list_intersect(ap, bp)) > 0 then 1.0 else 0.0 end::double", "pin_mismatch_penalty": f"case when {_ON} and len(ap) > 0 and len(bp) > 0 then case when len(list_intersect(ap, bp)) > 0 then -1.0 else 1.0 end else 0.0 end::double",
    "pin_both_present": f"case when {_ON} and len(ap) > 0 and len(bp) > 0 then 1.0 else 0.0 end::double", "is_s3": "(tgt_id like 'S3-%')::int::double", "len_s1_name": "length(an)::double", "len_cand_name": "length(bn)::double", "len_s1_addr": "length(aa)::double", "len_cand_addr": "length(ba)::double",
}


@query("features37_parts", f"with {PAIRS} select s1_id, tgt_id, " + ", ".join(f"{'round(' + v + ', 6)' if 'ratio' in k else v} as {k}" for k, v in _PARTS.items()) + " from pr")
def features37_parts(spark, d):
    out = features.features(all_pairs(spark, d), "p4")
    return out.select("s1_id", "tgt_id", *[F.round(c, 6).alias(c) if "ratio" in c else c for c in _PARTS])


@query("score_linear", f"with {PAIRS} select s1_id, tgt_id, round(0.6 * jaro_winkler_similarity(an, bn) + 0.4 * {_JACCARD('anum', 'bnum', '0')}, 6)::double as score from pr")
def score_linear(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["jaro_winkler"]))
    df = df.withColumn("jw", F.col("s.jaro_winkler")).withColumn("nj", similarity.jaccard(F.col("a_numbers"), F.col("b_numbers")))
    return df.select("s1_id", "tgt_id", F.round(model.linear({"jw": 0.6, "nj": 0.4}), 6).alias("score"))


@query("guards", f"""with recursive {PAIRS}, {oracle.ratios('select distinct an as a, bn as b from pr')} select s1_id, tgt_id from pr join ratio on an = a and bn = b
    where not (len(ap) > 0 and len(bp) > 0 and len(list_intersect(ap, bp)) = 0 and r < 90) and not (len(anum) > 0 and len(bnum) > 0 and len(list_intersect(anum, bnum)) = 0 and r < 85)""")
def guards(spark, d):
    df = all_pairs(spark, d).withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["ratio"]))
    return decide.guarded(df, F.col("s.ratio")).select("s1_id", "tgt_id")


_CAPPED = "select s1_id, tgt_id, score, row_number() over (partition by s1_id, substring(tgt_id, 1, 2) order by score desc, tgt_id)::int as rank from cand qualify row_number() over (partition by s1_id, substring(tgt_id, 1, 2) order by score desc, tgt_id) <= 3"


@query("cap_rank", f"with {V6} {_CAPPED}")
def cap_rank(spark, d):
    s1, tgt = parties(spark, d)
    return decide.capped(blocking.candidates(s1, tgt, PROFILES["v6"]).drop("rank"), {"S2": 3, "S3": 3})


@query("match_lists", f"with {V6}, cp as ({_CAPPED}), l as (select s1_id, string_agg(tgt_id, ',' order by substring(tgt_id, 1, 2), rank, tgt_id) as ids from cp group by s1_id) select entity_id as s1_id, coalesce(ids, '') as ids from norm left join l on entity_id = s1_id where src = 'S1'")
def match_lists(spark, d):
    s1, _ = parties(spark, d)
    return decide.match_lists(cap_rank(spark, d), s1)


@query("output_counters", f"with {V6}, cp as ({_CAPPED}), n as (select entity_id, count(s1_id) as n from norm left join cp on entity_id = s1_id where src = 'S1' group by 1) select count(*) as n_queries, count(*) filter (where n = 0) as n_singletons, count(*) filter (where n > 0) as n_matched, sum(n)::bigint as n_matches from n")
def output_counters(spark, d):
    return decide.counters(match_lists(spark, d))


# truth and quality


@query("truth_explode", f"select s1_id, tgt_id from ({TRUTH})")
def truth_explode(spark, d):
    lists = truth_of(spark, d).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("tgt_id")), " , ").alias("ids"))
    return lists.select("s1_id", F.explode(records.id_list(F.col("ids"))).alias("tgt_id"))


_ORDERS = f"tr as ({plain(testbeds.ORDER_TRUTH)}), sc as ({plain(testbeds.ORDER_SCORED)}), q as ({plain(testbeds.ORDER_KEYS)})"
_F05 = "case when nt = 0 and np = 0 then 1.0 when nt = 0 or np = 0 or tp = 0 then 0.0 else 1.25 * (tp / np::double) * (tp / nt::double) / (0.25 * (tp / np::double) + tp / nt::double) end::double"
_EACH = f"with {_ORDERS}, e as (select q.s1_id, (select count(*) from tr where tr.s1_id = q.s1_id) as nt, (select count(*) from sc where sc.s1_id = q.s1_id and score >= 5) as np, (select count(*) from sc join tr using (s1_id, tgt_id) where s1_id = q.s1_id and score >= 5) as tp from q), f as (select *, {_F05} as f05 from e)"


def _orders(spark, d):
    return load(spark, d, testbeds.ORDER_KEYS), load(spark, d, testbeds.ORDER_TRUTH), load(spark, d, testbeds.ORDER_SCORED)


@query("entity_f05", f"{_EACH} select s1_id, nt as n_truth, np as n_pred, tp, round(f05, 6) as f05 from f")
def entity_f05(spark, d):
    q, t, s = _orders(spark, d)
    return metrics.entity_f05(q, t, s.filter("score >= 5")).withColumn("f05", F.round("f05", 6))


@query("macro_f05", f"{_EACH} select round(avg(f05), 6) as macro_f05, round(avg(f05) filter (where nt = 0), 6) as singleton_f05, round(avg(f05) filter (where nt > 0), 6) as matched_f05, count(*) as n_queries, count(*) filter (where nt = 0) as n_singletons, count(*) filter (where nt > 0) as n_matched from f")
def macro_f05(spark, d):
    q, t, s = _orders(spark, d)
    out = metrics.macro_f05(q, t, s.filter("score >= 5"))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("f05") else c for c in out.columns])


@query("threshold_sweep", f"""with {_ORDERS}, th as (select unnest(range(1, 10))::int as threshold),
    n as (select s1_id, count(*) as nt from tr group by 1), p as (select threshold, sc.s1_id, count(*) as np, count(tr.tgt_id) as tp from th join sc on score >= threshold left join tr using (s1_id, tgt_id) group by all),
    e as (select th.threshold, q.s1_id, coalesce(nt, 0) as nt, coalesce(np, 0) as np, coalesce(tp, 0) as tp from th cross join q left join n using (s1_id) left join p on p.threshold = th.threshold and p.s1_id = q.s1_id),
    m as (select threshold, avg({_F05}) as m from e group by 1) select threshold, round(m, 6) as macro_f05, row_number() over (order by round(m, 12) desc, threshold) = 1 as is_best from m""")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(*_orders(spark, d), list(range(1, 10))).withColumn("macro_f05", F.round("macro_f05", 6))


# samples


_HELD = "('0x' || substring(md5({} || ':42'), 1, 8))::bigint % 100 < 25"


@query("group_split", f"select o_orderkey, {_HELD.format('o_orderkey::varchar')} as is_validation from orders")
def group_split(spark, d):
    return sampling.group_split(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), F.col("o_orderkey"))


@query("group_split_hashed", f"select s1_id, tgt_id, {_HELD.format('s1_id::varchar')} as is_validation from ({plain(testbeds.ORDER_TRUTH)})")
def group_split_hashed(spark, d):
    return sampling.group_split(load(spark, d, testbeds.ORDER_TRUTH), F.col("s1_id"))


@query("sliced_split", "select o_orderkey, case when rk <= 200 then 'validation' else 'train' end as part from (select o_orderkey, row_number() over (order by o_orderkey % 97, o_orderkey) as rk from orders) where rk <= 600")
def sliced_split(spark, d):
    val, train = sampling.sliced(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), [F.col("o_orderkey") % 97, F.col("o_orderkey")], 200, 400)
    return val.withColumn("part", F.lit("validation")).unionByName(train.withColumn("part", F.lit("train")))


_NUMBER = "cast(substring(entity_id, 4) as bigint)"


@query("stratified_sample", f"select entity_id, country from ({PARTIES}) where entity_id like 'S1-%' qualify row_number() over (partition by country order by {_NUMBER} % 13, {_NUMBER}) <= 25")
def stratified_sample(spark, d):
    df = load(spark, d, testbeds.PARTIES).filter("entity_id like 'S1-%'").select("entity_id", "country")
    return sampling.stratified(df, "country", [F.expr(_NUMBER) % 13, F.expr(_NUMBER)], 25)


@query("stratified_folds", f"select entity_id, country, ntile(5) over (partition by country order by {_NUMBER})::int as fold from ({PARTIES}) where entity_id like 'S1-%'")
def stratified_folds(spark, d):
    df = load(spark, d, testbeds.PARTIES).filter("entity_id like 'S1-%'").select("entity_id", "country")
    return sampling.folds(df, "country", [F.expr(_NUMBER)])


@query("training_pairs", f"with {V6}, tr as ({TRUTH}), u as (select s1_id, tgt_id from cand union select s1_id, tgt_id from tr) select s1_id, tgt_id, case when (s1_id, tgt_id) in (select (s1_id, tgt_id) from tr) then 1.0 else 0.0 end::double as label from u")
def training_pairs(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.labelled(blocking.candidates(s1, tgt, PROFILES["v6"]), truth_of(spark, d))


@query("label_counts", f"with {V6}, tr as ({TRUTH}), u as (select cand.s1_id, tr.tgt_id is not null as l from cand left join tr using (s1_id, tgt_id)) select l::int::double as label, count(*) as n from u group by 1")
def label_counts(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.labelled(blocking.candidates(s1, tgt, PROFILES["v6"]), truth_of(spark, d), with_truth=False).groupBy("label").agg(F.count("*").alias("n"))


@query("capped_negatives", f"with {V6}, tr as ({TRUTH}) select s1_id, tgt_id, score, cand.rank as rank, row_number() over (partition by s1_id order by cand.rank)::int as n from cand where (s1_id, tgt_id) not in (select (s1_id, tgt_id) from tr) qualify n <= 4")
def capped_negatives(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.capped_negatives(blocking.candidates(s1, tgt, PROFILES["v6"]), truth_of(spark, d), 4)


def _hard(kind: str, key: str, looked: int, taken: int) -> None:
    @query(f"hard_neg_{kind}", f"""{NORM_PARTIES}, tr as ({TRUTH}), ks as (select country, entity_id, src, unnest(k) as key, generate_subscripts(k, 1) as pos from (select country, entity_id, src, {key} as k from norm)),
        po as (select country, key, entity_id as tgt_id, row_number() over (partition by country, key order by entity_id) as rk from ks where src <> 'S1' qualify rk <= {looked}),
        me as (select entity_id as s1_id, tgt_id, rk, pos, min(pos) over (partition by entity_id) as least from ks join po using (country, key) where src = 'S1')
        select s1_id, tgt_id from me where pos = least and (s1_id, tgt_id) not in (select (s1_id, tgt_id) from tr) qualify row_number() over (partition by s1_id order by rk) <= {taken}""")
    def hard(spark, d):
        s1, tgt = parties(spark, d)
        return sampling.hard_negatives(s1, tgt, truth_of(spark, d), kind)


_hard("brand", "case when brand_root <> '' then [brand_root] else [] end", 3, 1)
_hard("token", "list_filter(name_tokens, lambda t, i: length(t) >= 4 and list_position(name_tokens, t) = i)", 2, 2)
_hard("postal", "postals", 2, 2)


@query("mined_pairs", f"""with recursive {PAIRS}, tr as ({TRUTH}), mp as (select s1_id, tgt_id, 0 as rank, true as l from tr union all select s1_id, tgt_id, rank, false from cand where rank <= 10 and (s1_id, tgt_id) not in (select (s1_id, tgt_id) from tr)),
    mn as (select mp.*, a.c_name as a, b.c_name as b from mp join norm a on a.entity_id = s1_id join norm b on b.entity_id = tgt_id), {oracle.token_sets("select distinct a, b from mn")},
    ok as (select s1_id, tgt_id, l, row_number() over (partition by s1_id, l order by rank, tgt_id) as n from mn join ratio using (a, b) join token_set using (a, b) where not (ratio.r < 35 and ts < 40 and a <> b))
    select s1_id, tgt_id, case when l then 1.0 else 0.0 end::double as label from ok where l or n <= 4""")
def mined_pairs(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.mined(blocking.candidates(s1, tgt, PROFILES["stage1"], 10), truth_of(spark, d), s1, tgt, 4)


@query("first_postings", f"""{NORM_PARTIES}, tr as ({TRUTH}), tk as (select country, entity_id, src, unnest(list_distinct([t for t in name_tokens if length(t) >= 3])) as t from norm),
    po as (select country, t, entity_id as tgt_id from tk where src <> 'S1' qualify row_number() over (partition by country, t order by src, entity_id) <= 15),
    u as (select entity_id as s1_id, tgt_id from tk join po using (country, t) where src = 'S1' union select s1_id, tgt_id from tr)
    select s1_id, tgt_id, case when (s1_id, tgt_id) in (select (s1_id, tgt_id) from tr) then 1.0 else 0.0 end::double as label from u""")
def first_postings(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.first_postings(s1, tgt, truth_of(spark, d))


@query("positives_and_random")
def positives_and_random(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.positives_and_random(truth_of(spark, d), s1, tgt)


@query("all_hard_negatives")
def all_hard_negatives(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.all_hard_negatives(s1, tgt, truth_of(spark, d))


@query("random_negatives")
def random_negatives(spark, d):
    s1, tgt = parties(spark, d)
    return sampling.random_negatives(s1, tgt, 500)


# validation

_ROWS = f"rw as (select entity_id as s1_id, case when g % 17 = 0 then 'S2-' || g || ',S2-' || g when g % 19 = 0 then 'S1-' || g when g % 23 = 0 then 'X-' || g when g % 29 = 0 then 'S2-9' || g || '77' when g % 31 = 0 then 'S2-1, S2-2' when g % 5 <> 0 then 'S2-' || g else '' end as ids, g from (select entity_id, cast(substring(entity_id, 4) as bigint) as g from {{p}} where entity_id like 'S1-%') where g % 37 <> 0 union all select 'S1-4', 'S3-5', 4 union all select 'S1-none', '', 0)"


def _result_rows(spark, d) -> DataFrame:
    p = load(spark, d, testbeds.PARTIES)
    return spark.sql(f"with {_ROWS.format(p='{p}')} select s1_id, ids, true as has_tab from rw", p=p)


_VALID = f"""with tr as ({TRUTH}), pa as ({PARTIES}), {_ROWS.format(p='pa')}, en as (select s1_id, unnest(string_split(ids, ',')) as t from rw where ids <> ''), v as (
    select 'V5' as rule, s1_id as id from rw group by s1_id having count(*) > 1
    union all select distinct 'V6', s1_id from (select s1_id, t from en group by all having count(*) > 1)
    union all select distinct 'V7', t from en where t like 'S1-%' union all select distinct 'V8', t from en where t not like 'S1-%' and t not like 'S2-%' and t not like 'S3-%'
    union all select distinct 'V9', t from en where (t like 'S2-%' or t like 'S3-%') and t not in (select entity_id from pa)
    union all select 'V10', entity_id from pa where entity_id like 'S1-%' and entity_id not in (select s1_id from rw)
    union all select distinct 'V11', s1_id from rw where s1_id not in (select entity_id from pa)
    union all select distinct 'V12', s1_id from en where (s1_id, t) not in (select (s1_id, tgt_id) from tr))"""


def _violations(spark, d) -> DataFrame:
    p = load(spark, d, testbeds.PARTIES)
    lists = truth_of(spark, d).groupBy("s1_id").agg(F.array_join(F.collect_list("tgt_id"), ",").alias("ids")).withColumn("has_tab", F.lit(True))
    required = p.filter("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1_id"))
    return validate.violations(_result_rows(spark, d), required, p.select(F.col("entity_id").alias("tgt_id")), lists)


@query("validate_violations", f"{_VALID} select rule, case when rule = 'V12' then 'warning' else 'error' end as severity, id from v")
def validate_violations(spark, d):
    return _violations(spark, d)


@query("validate_report", f"{_VALID}, r as (select *, row_number() over (partition by rule order by id) as rk from v) select rule, case when rule = 'V12' then 'warning' else 'error' end as severity, count(*) as n, string_agg(id, ',' order by id) filter (where rk <= 5) as examples from r group by all")
def validate_report(spark, d):
    return validate.report(_violations(spark, d))


# models


def _training(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All candidates and true pairs with their label and pair of texts, the vectors of these, and what is learnt from: each
    vector once for each label, with how many pairs it stands for."""
    s1, tgt = parties(spark, d)
    scratch = Scratch(spark, "training")
    s1, tgt = scratch.save(s1), scratch.save(tgt)
    found = sampling.labelled(blocking.candidates(s1, tgt, PROFILES["v6"]), truth_of(spark, d))
    rows, vectors = features.by_class(found, s1, tgt, "p4", scratch)
    rows, vectors = scratch.save(rows), vectors.na.fill(0.0)
    learnt = scratch.save(apart(vectors).join(rows.groupBy("pair", "label").agg(F.count("*").cast("double").alias("pairs")), "pair"))
    return rows, vectors, learnt


def _scored(rows: DataFrame, scored: DataFrame) -> DataFrame:
    return rows.join(apart(scored.select("pair", "probability_1")), "pair").select("s1_id", "tgt_id", "label", "probability_1")


@query("gbt_score")
def gbt_score(spark, d):
    rows, vectors, learnt = _training(spark, d)
    return _scored(rows, model.predict(model.train(learnt, features.P4, weight="pairs"), vectors))


@query("blend_score")
def blend_score(spark, d):
    rows, vectors, learnt = _training(spark, d)
    return _scored(rows, model.blend(model.train(learnt, features.P4, weight="pairs"), model.train(learnt, features.P4, "rf", weight="pairs"), vectors))


@query("resolve_rule", f"""with recursive {V6}, pr as (select s1_id, tgt_id, a.c_name as an, b.c_name as bn from cand join norm a on a.entity_id = s1_id join norm b on b.entity_id = tgt_id), jw as (select s1_id, tgt_id, round(jaro_winkler_similarity(an, bn), 9) as score from pr where jaro_winkler_similarity(an, bn) >= 0.9),
    cp as (select *, row_number() over (partition by s1_id, substring(tgt_id, 1, 2) order by score desc, tgt_id) as rank from jw qualify rank <= 3), l as (select s1_id, string_agg(tgt_id, ',' order by substring(tgt_id, 1, 2), rank) as ids from cp group by 1)
    select entity_id as s1_id, coalesce(ids, '') as ids from norm left join l on entity_id = s1_id where src = 'S1'""")
def resolve_rule(spark, d):
    from tessera.plans.link import resolve_by_rule

    return resolve_by_rule(load(spark, d, testbeds.PARTIES), PROFILES["v6"], 0.9)


_SCORED = f"0.6 * (r / 100) + 0.4 * case when {_ON} and len(anum) > 0 and len(bnum) > 0 then {_JACCARD('anum', 'bnum', '0')} else 0.0 end"


@query("resolve_linear", f"""with recursive {PAIRS}, {oracle.ratios('select distinct an as a, bn as b from pr')}, sc as (select *, round({_SCORED}, 9) as score from pr join ratio on an = a and bn = b),
    gu as (select * from sc where score >= {PROFILES['v6'].threshold} and not (len(ap) > 0 and len(bp) > 0 and len(list_intersect(ap, bp)) = 0 and r < 90) and not (len(anum) > 0 and len(bnum) > 0 and len(list_intersect(anum, bnum)) = 0 and r < 85)),
    cp as (select s1_id, tgt_id, row_number() over (partition by s1_id, substring(tgt_id, 1, 2) order by score desc, tgt_id) as rank from gu qualify rank <= 3),
    l as (select s1_id, string_agg(tgt_id, ',' order by substring(tgt_id, 1, 2), rank) as ids from cp group by 1)
    select entity_id as s1_id, coalesce(ids, '') as ids from norm left join l on entity_id = s1_id where src = 'S1'""")
def resolve_linear(spark, d):
    """The whole path of inference with a fixed linear score for a model."""
    from tessera.plans.link import resolve

    return resolve(load(spark, d, testbeds.PARTIES), F.round(model.linear({"name_ratio": 0.6, "num_jaccard": 0.4}), 9), PROFILES["v6"])[0]
