"""Normalisation of names and addresses, as Column functions without UDFs."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that are dropped from names, by vocabulary.
LEGAL = ["inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "pvt ltd", "co", "company", "group", "holdings", "enterprises", "associates", "llp", "pllc", "gmbh", "sarl", "sas", "sa", "eurl", "sasu", "sci", "snc", "gie", "spa", "bv"]
LEGAL_WIDE = [*LEGAL, "and sons", "and co", "traders", "agency", "agencies", "industries", "center", "services", "solutions", "technologies", "consultancy"]
# Ends of web names.
TLD = r"\.(com|in|org|net|co|io|fr|us|biz|info|ai|edu|gov)(/.*)?$"
TLD_WIDE = r"\.(com|in|org|net|co|io|fr|us|biz|info|ai|edu|gov|eu|uk)(/.*)?$"
# What address words stand for.
ABBREVIATIONS = {"rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment", "dept": "department", "fl": "floor", "bldg": "building", "opp": "opposite", "nr": "near", "dist": "district", "sec": "sector", "pk": "park"}
# Terms that brand roots leave out, by vocabulary.
ROOT_TERMS = r"\b(pvt ltd|private limited|ltd|llc|inc|incorporated|corp|corporation|co|company|sarl|sa|gmbh|enterprises|enterprise|services|service|store|stores|trading|agency|holdings|group)\b"
ROOT_TERMS_WIDE = r"\b(pvt|ltd|limited|private|inc|incorporated|corp|corporation|llc|llp|gmbh|sa|sarl|srl|bv|co|company|plc|enterprises|enterprise|services|service|solutions|industries|holdings|group)\b"


def _ascii(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Letters with one ASCII stand-in, these stand-ins, and the signs with longer ones, of all of Unicode: planes past
    the third hold none."""
    folded = [(chr(i), _ascii(chr(i))) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000]
    one = [(c, x) for c, x in folded if len(x) == 1]
    return "".join(c for c, _ in one), "".join(x for _, x in one), {c: x for c, x in folded if len(x) > 1}


_FROM, _TO, _LONG = _fold_tables()


def missing_as_empty(x: Column) -> Column:
    return F.when(x.isNull() | (F.lower(x) == "nan"), "").otherwise(x)


def _ranges(signs: str) -> str:
    """What a character class of these signs says; signs that follow each other are one range."""
    out: list[list[int]] = []
    for i in sorted(map(ord, signs)):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def fold(x: Column) -> Column:
    """ASCII stand-ins of letters; other signs go. Texts of ASCII stay as they are; others are taken as runs of ASCII and
    single signs with a longer stand-in, and only these are looked up."""
    table = F.str_to_map(F.lit("\x02".join(f"{c}\x01{s}" for c, s in _LONG.items())), F.lit("\x02"), F.lit("\x01"))
    pieces = F.regexp_extract_all(F.translate(x, _FROM, _TO), F.lit(f"[\\x00-\\x7F]+|[{_ranges(''.join(_LONG))}]"), F.lit(0))
    spelled = F.array_join(F.transform(pieces, lambda c: F.when(c < "\x80", c).otherwise(F.try_element_at(table, c))), "")
    return F.when(F.length(x) == F.octet_length(x), x).otherwise(spelled)


def strip(x: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def fold_all(x: Column) -> Column:
    """The same by full compatibility decomposition, for scripts beyond the tables."""

    @F.arrow_udf("string")
    def made(v: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _ascii(t) for t in v.to_pylist()], pa.string())

    return made(x)


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def clean_name(x: Column, legal: list[str] = LEGAL, tld: str = TLD) -> Column:
    x = strip(F.lower(fold(missing_as_empty(x))))
    x = F.regexp_replace(F.regexp_replace(x, r"^https?://", ""), r"^www\.", "")
    x = F.regexp_replace(x, tld, "")
    for sign, word in (("&", " and "), ("@", " at "), ("+", " plus ")):
        x = F.replace(x, F.lit(sign), F.lit(word))
    return drop_words(F.regexp_replace(x, r"[^a-z0-9\s]", " "), legal)


def drop_words(x: Column, words: list[str]) -> Column:
    """x without these words, or all of it if no other is there."""
    kept = F.filter(F.split(x, r"\s+"), lambda t: (t != "") & ~t.isin(words))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.array_join(tokens(x), " "))


def clean_address(x: Column) -> Column:
    x = F.replace(strip(F.lower(fold(missing_as_empty(x)))), F.lit("#"), F.lit(" number "))
    table = F.create_map(*[F.lit(v) for pair in ABBREVIATIONS.items() for v in pair])
    return F.array_join(F.transform(tokens(F.regexp_replace(x, r"[^a-z0-9\s]", " ")), lambda t: F.when(t.isin(list(ABBREVIATIONS)), F.try_element_at(table, t)).otherwise(t)), " ")


def plain_clean(x: Column) -> Column:
    """Lower case, marks as spaces; no folding and no dropped words."""
    return F.array_join(tokens(F.regexp_replace(F.lower(missing_as_empty(x)), r"[^a-z0-9\s]", " ")), " ")


def numbers(x: Column, distinct: bool = True) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"\b\d+\b"), F.lit(0))
    return F.array_distinct(found) if distinct else found


def postals(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b\d{5,6}\b"), F.lit(0)))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def brand_root(x: Column, terms: str = ROOT_TERMS) -> Column:
    return F.array_join(tokens(F.regexp_replace(x, f"(?i){terms}", "")), " ")


def char_ngrams(x: Column, n: int = 3, short: str = "none") -> Column:
    """Distinct n-grams. Of texts shorter than n: nothing, or with short="whole" the text itself."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substr(x, i, F.lit(n)))
    rest = F.when(x != "", F.array(x)).otherwise(F.array().cast("array<string>")) if short == "whole" else F.array().cast("array<string>")
    return F.when(F.length(x) >= n, F.array_distinct(grams)).otherwise(rest)


def prefix2(x: Column) -> Column:
    """First two tokens with _ between; null if there are fewer."""
    t = tokens(x)
    return F.when(F.size(t) >= 2, F.concat_ws("_", F.get(t, F.lit(0)), F.get(t, F.lit(1))))


def localities(x: Column) -> Column:
    """Distinct address words of four letters or more that are no numbers."""
    return F.array_distinct(F.filter(tokens(x), lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\d+$")))


def number_locality(address: Column, distinct: bool = False) -> Column:
    words = localities(address)
    return F.flatten(F.transform(numbers(address, distinct), lambda n: F.transform(words, lambda t: F.concat(n, F.lit("_"), t))))
