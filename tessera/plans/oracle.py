"""SQL pieces for checking queries in another engine (DuckDB): normalisation, keys, blocking, string ratios."""

from __future__ import annotations

from tessera.functions import text
from tessera.operators.blocking import UNIT, Profile


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def fold(x: str) -> str:
    return f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"


def tokens(x: str) -> str:
    return f"[t for t in string_split_regex({x}, '\\s+') if t <> '']"


def _missing(x: str) -> str:
    return f"case when lower({x}) = 'nan' then '' else {x} end"


def normalised(records: str, legal: list[str] = text.LEGAL, tld: str = text.TLD, terms: str = text.ROOT_TERMS) -> str:
    """CTEs from `recs` (entity_id, business_name, business_address, country) to `norm` with the derived columns."""
    meant = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in text.ABBREVIATIONS.items()) + " else t end"
    return f"""recs as ({records}),
    n1 as (select *, regexp_replace(regexp_replace(regexp_replace(trim(lower({fold(_missing("business_name"))})), '^https?://', ''), '^www\\.', ''), '{tld}', '') as u,
        {tokens(f"regexp_replace(replace(trim(lower({fold(_missing('business_address'))})), '#', ' number '), '[^a-z0-9\\s]', ' ', 'g')")} as adr from recs),
    n2 as (select *, {tokens("regexp_replace(replace(replace(replace(u, '&', ' and '), '@', ' at '), '+', ' plus '), '[^a-z0-9\\s]', ' ', 'g')")} as nt from n1),
    n3 as (select *, [t for t in nt if t not in {_list(legal)}] as kt from n2),
    n4 as (select entity_id, country, business_name, coalesce(array_to_string(case when len(kt) > 0 then kt else nt end, ' '), '') as c_name,
        coalesce(array_to_string([{meant} for t in adr], ' '), '') as c_addr from n3),
    norm as (select *, substring(entity_id, 1, 2) as src, regexp_replace(c_name, '[^a-z0-9]', '', 'g') as comp_name,
        coalesce(array_to_string({tokens(f"regexp_replace(c_name, '(?i){terms}', '', 'g')")}, ' '), '') as brand_root,
        regexp_extract_all(c_addr, '\\b\\d+\\b') as numbers, list_distinct(regexp_extract_all(c_addr, '\\b\\d{{5,6}}\\b')) as postals,
        {tokens("c_name")} as name_tokens from n4)"""


def _grams(x: str, short: bool) -> str:
    rest = f"case when {x} <> '' then [{x}] else [] end" if short else "[]"
    return f"case when length({x}) >= 3 then list_distinct([substring({x}, i::bigint, 3) for i in range(1, length({x}) - 1)]) else {rest} end"


def keys(profile: Profile, query: bool, where: str) -> str:
    """select country, channel, key, id over `norm`."""
    local = "list_distinct([t for t in string_split_regex(c_addr, '\\s+') if length(t) >= 4 and not regexp_full_match(t, '\\d+')])"
    numbers = "numbers" if query and profile.repeated_numbers else "list_distinct(numbers)"
    each = {
        "exact": "case when c_name <> '' then [c_name] else [] end",
        "prefix2": "case when len(name_tokens) >= 2 then [name_tokens[1] || '_' || name_tokens[2]] else [] end",
        "compact": "case when length(comp_name) >= 5 then [comp_name] else [] end",
        "root": "case when length(brand_root) >= 4 then [brand_root] else [] end",
        "token": "list_distinct([t for t in name_tokens if length(t) >= 3])",
        "char3": _grams("comp_name", True) if profile.ngrams == "compact" else _grams("c_name", False),
        "number": f"flatten([[n || '_' || t for t in {local}] for n in {numbers}])",
    }
    return " union all ".join(f"select country, '{c}' as channel, unnest({each[c]}) as key, entity_id as id from norm where {where}" for c in profile.channels)


def candidates(records: str, profile: Profile, top_k: int | None = None) -> str:
    """WITH list that ends in `cand` (s1_id, tgt_id, score, rank)."""
    of = lambda f: "case channel " + " ".join(f"when '{n}' then {v}" for n, c in profile.channels.items() if (v := f(c)) is not None) + " else null end"
    ceiling = of(lambda c: c.max_df) if any(c.max_df for c in profile.channels.values()) else "null"
    cap = of(lambda c: c.cap) if any(c.cap for c in profile.channels.values()) else "null"
    idf = [n for n, c in profile.channels.items() if c.idf]
    weight = f"({of(lambda c: c.weight)})::double / case when channel in {_list(idf)} then 1 + ln(1 + df::double) else 1.0 end"
    return f"""{normalised(records)},
    sk as ({keys(profile, True, "src = 'S1'")}), tk as ({keys(profile, False, "src <> 'S1'")}),
    posted as (select *, count(*) over (partition by country, channel, key) as df, row_number() over (partition by country, channel, key order by substring(id, 1, 2), id) as rk from tk),
    idx as (select country, channel, key, id as tgt_id, floor({weight} * {UNIT})::bigint as w from posted where coalesce(df <= {ceiling}, true) and coalesce(rk <= {cap}, true)),
    summed as (select sk.id as s1_id, tgt_id, sum(w)::bigint as s from sk join idx using (country, channel, key) group by all),
    cand as (select s1_id, tgt_id, round(s / {UNIT}.0::double, 6) as score, row_number() over (partition by s1_id order by s desc, substring(tgt_id, 1, 2), tgt_id)::int as rank from summed
        qualify rank <= {top_k or profile.top_k})"""


def ratios(pairs: str) -> str:
    """CTEs from a query of distinct (a, b) to `ratio` (a, b, r): the row of a longest common subsequence, letter by
    letter of b. Needs WITH RECURSIVE."""
    return f"""ab as ({pairs}),
    walk(a, b, k, row) as (select a, b, 0, [0 for x in range(length(a))] from ab
        union all select a, b, k + 1, list_transform(range(1, length(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], case when a[i] = b[k + 1] then coalesce(row[i - 1], 0) + 1 else 0 end)))) from walk where k < length(b)),
    ratio as (select a, b, case when a = '' and b = '' then 100.0 else 200.0 * coalesce(row[length(a)], 0) / (length(a) + length(b)) end as r from walk where k = length(b))"""


def token_sets(pairs: str) -> str:
    """CTEs from a query of distinct (a, b) to `ratio` of these, and `token_set` (a, b, ts). Needs WITH RECURSIVE."""
    return f"""tp as ({pairs}), tw as (select a, b, list_sort(list_distinct({tokens("a")})) as ta, list_sort(list_distinct({tokens("b")})) as tb from tp),
    tc as (select a, b, ta, tb, [t for t in ta if list_contains(tb, t)] as shared, [t for t in ta if not list_contains(tb, t)] as ra, [t for t in tb if not list_contains(ta, t)] as rb from tw),
    tj as (select *, coalesce(array_to_string(shared, ' '), '') as sh, coalesce(array_to_string(list_concat(shared, ra), ' '), '') as x, coalesce(array_to_string(list_concat(shared, rb), ' '), '') as y from tc),
    {ratios("select a, b from tp union select x, y from tj union select sh, x from tj union select sh, y from tj")},
    token_set as (select tj.a, tj.b, case when len(ta) = 0 or len(tb) = 0 then 0.0 when len(shared) > 0 and (len(ra) = 0 or len(rb) = 0) then 100.0 else greatest(p.r, q.r, s.r) end as ts from tj
        join ratio p on p.a = x and p.b = y join ratio q on q.a = sh and q.b = x join ratio s on s.a = sh and s.b = y)"""
