"""Feature vectors of candidate pairs: 17, 28, 28 in the fast form, and 37 columns.

Pairs carry a_ and b_ columns of the preprocessed records (see `pairs`). String kernels come from one Arrow UDF for each
text pair; all else are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import classes
from tessera.sources.scratch import Scratch, apart

# The columns of each vector, in order.
P1 = "name_ratio name_partial_ratio name_token_sort name_token_set name_wratio name_exact_match name_len_diff name_len_ratio addr_ratio addr_token_set addr_token_sort addr_partial_ratio addr_is_missing num_common_count num_jaccard num_mismatch_penalty is_s3".split()
P2 = "name_ratio name_partial_ratio name_token_sort name_token_set name_wratio name_exact_match name_len_diff name_len_ratio name_first_token_match name_last_token_match name_char_jaccard_3gram name_compact_ratio addr_ratio addr_token_set addr_token_sort addr_partial_ratio addr_is_missing addr_first_token_match num_common_count num_jaccard num_mismatch_penalty pin_exact_match pin_both_present name_addr_avg is_s3 len_s1_name len_cand_name len_s1_addr".split()
P4 = "name_ratio name_partial_ratio name_token_sort name_token_set name_wratio name_jaro_winkler name_exact_match name_len_diff name_len_ratio name_first_token_match name_last_token_match name_char_jaccard_3gram brand_root_ratio brand_root_exact brand_root_token_set compact_ratio compact_exact addr_ratio addr_token_set addr_token_sort addr_partial_ratio addr_is_missing addr_first_token_match addr_jaro_winkler num_common_count num_jaccard num_mismatch_penalty pin_exact_match pin_mismatch_penalty pin_both_present name_addr_avg brand_addr_avg is_s3 len_s1_name len_cand_name len_s1_addr len_cand_addr".split()
VECTORS = {"p1": P1, "p2": P2, "p3": P2, "p4": P4}

_COLUMNS = ("c_name", "c_addr", "brand_root", "comp_name", "numbers", "postals")


def pairs(candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """candidates (s1_id, tgt_id, ...) with both records' derived columns; unknown ids fall away."""
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in _COLUMNS])
    b = targets.select(F.col("entity_id").alias("tgt_id"), *[F.col(c).alias(f"b_{c}") for c in _COLUMNS])
    return candidates.join(a, "s1_id").join(b, "tgt_id")


def by_class(candidates: DataFrame, s1: DataFrame, targets: DataFrame, kind: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Vectors of candidates (s1_id, tgt_id, ...), each once for all pairs of records whose texts are the same: candidates
    with their `pair`, and (pair, the vector's columns). A vector depends on both texts and on whether the target is of S3.
    Unknown ids fall away, as do pairs that the fast form drops, in the vectors only."""
    (a, asked), (b, held) = (classes.of(x, list(_COLUMNS), scratch) for x in (s1, targets))
    met = candidates.join(apart(asked.toDF("a_class", "s1_id")), "s1_id").join(apart(held.toDF("b_class", "tgt_id")), "tgt_id").withColumn("s3", F.col("tgt_id").startswith("S3-"))
    met = scratch.save(met)
    of = ["a_class", "b_class", "s3"]
    numbered = scratch.save(met.groupBy(*of).agg(F.min("tgt_id").alias("tgt_id")).withColumn("pair", F.monotonically_increasing_id()))
    texts = numbered
    for x, side in ((a, "a"), (b, "b")):
        texts = texts.join(apart(x.select(F.col("class").alias(f"{side}_class"), *[F.col(c).alias(f"{side}_{c}") for c in _COLUMNS])), f"{side}_class")
    # kernels are the work here, whatever the bytes
    vectors = features(texts.repartition(4 * s1.sparkSession.sparkContext.defaultParallelism, "pair"), kind, ("pair",))
    return met.join(apart(numbered.select(*of, "pair")), of).drop(*of), scratch.save(vectors)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _far(name: str = "_n") -> Column:
    """Whether the names of a pair, with their similarities in the struct `name`, are too far apart for the fast form."""
    return (F.col(f"{name}.ratio") < 35) & (F.col(f"{name}.token_set") < 40) & (F.col("a_c_name") != F.col("b_c_name"))


def passing(df: DataFrame) -> DataFrame:
    """The pairs that the fast form keeps."""
    both = similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["ratio", "token_set"])
    return df.withColumn("_n", both).filter(~_far()).drop("_n")


def _grams(name: str, grams: str) -> Column:
    """Letter triples of a record's name: "compact" and "raw_whole" give shorter texts whole, "raw" gives none for them."""
    return text.char_ngrams(F.col(f"{name}_comp_name" if grams == "compact" else f"{name}_c_name"), short="none" if grams == "raw" else "whole")


def features(df: DataFrame, kind: str = "p3", keep: tuple[str, ...] = ("s1_id", "tgt_id"), grams: str | None = None) -> DataFrame:
    """df's `keep` columns and the vector `kind`; p3 drops pairs whose names are far apart. grams: which letter triples of
    the names are compared, "compact", "raw" or "raw_whole"; by default those of the kind's last generation."""
    late = kind in ("p3", "p4")  # these run the kernels on empty names too
    a, b, x, y = F.col("a_c_name"), F.col("b_c_name"), F.col("a_c_addr"), F.col("b_c_addr")
    name_kernels = ["ratio", "partial", "token_sort", "token_set", "wratio", *(["jaro_winkler"] if kind == "p4" else [])]
    df = df.withColumn("_n", similarity.similarities(a, b, name_kernels))
    if kind == "p3":
        df = df.filter(~_far())
    df = df.withColumn("_a", similarity.similarities(x, y, ["ratio", "partial", "token_sort", "token_set", *(["jaro_winkler"] if kind == "p4" else [])]))
    named, placed = (a != "") & (b != ""), (x != "") & (y != "")
    own = lambda c, fine: c if fine is None else F.when(fine, c).otherwise(0.0)
    name = lambda k, scale=100.0: own(F.col(f"_n.{k}") / scale, None if late else named)
    addr = lambda k, scale=100.0: own(F.col(f"_a.{k}") / scale, placed)
    longest = F.greatest(F.length(a), F.length(b))
    shortest = F.least(F.length(a), F.length(b))
    nums, pins = F.size(F.array_intersect("a_numbers", "b_numbers")), F.arrays_overlap("a_postals", "b_postals")
    both = lambda c: (F.size(f"a_{c}") > 0) & (F.size(f"b_{c}") > 0)
    ta, tb = text.tokens(a), text.tokens(b)
    ca, cb = F.col("a_comp_name"), F.col("b_comp_name")
    triples = [_grams(x, grams or ("raw_whole" if kind == "p3" else "raw")) for x in "ab"]
    gram_jaccard = own(similarity.jaccard(*triples, epsilon=1e-5), (F.size(triples[0]) > 0) & (F.size(triples[1]) > 0) if late else named)
    first = F.substring(x, 1, 6) == F.substring(y, 1, 6) if late else F.get(text.tokens(x), F.lit(0)) == F.get(text.tokens(y), F.lit(0))
    values = {
        "name_ratio": name("ratio"), "name_partial_ratio": name("partial"), "name_token_sort": name("token_sort"), "name_token_set": name("token_set"), "name_wratio": name("wratio"),
        "name_exact_match": _flag((a == b) if late else (a == b) & named),
        "name_len_diff": F.abs(F.length(a) - F.length(b)).cast("double"),
        "name_len_ratio": F.when(longest > 0, shortest / longest).otherwise(1.0) if late else F.when(named, shortest / longest).otherwise(0.0),
        "name_first_token_match": _flag((F.size(ta) > 0) & (F.size(tb) > 0) & (F.get(ta, F.lit(0)) == F.get(tb, F.lit(0)))),
        "name_last_token_match": _flag((F.size(ta) > 0) & (F.size(tb) > 0) & (F.try_element_at(ta, F.lit(-1)) == F.try_element_at(tb, F.lit(-1)))),
        "name_char_jaccard_3gram": gram_jaccard,
        "addr_ratio": addr("ratio"), "addr_token_set": addr("token_set"), "addr_token_sort": addr("token_sort"), "addr_partial_ratio": addr("partial"),
        "addr_is_missing": _flag(~placed),
        "addr_first_token_match": own(_flag(first), placed),
        "num_common_count": own(nums.cast("double"), placed),
        "num_jaccard": own(similarity.jaccard(F.col("a_numbers"), F.col("b_numbers")), placed & both("numbers")),
        "num_mismatch_penalty": own(F.when(both("numbers"), F.when(nums > 0, 1.0).otherwise(-1.0)).otherwise(0.0), placed),
        "pin_both_present": own(_flag(both("postals")), placed),
        "is_s3": _flag(F.col("tgt_id").startswith("S3-")),
        "len_s1_name": F.length(a).cast("double"), "len_cand_name": F.length(b).cast("double"), "len_s1_addr": F.length(x).cast("double"), "len_cand_addr": F.length(y).cast("double"),
    }
    pin = F.when(both("postals"), F.when(pins, 1.0).otherwise(-1.0)).otherwise(0.0)
    average = lambda n: F.when(placed, (n + F.col("_a.ratio") / 100) / 2).otherwise(n)
    values["name_addr_avg"] = average(values["name_ratio"])
    if kind == "p4":
        ra, rb = F.col("a_brand_root"), F.col("b_brand_root")
        df = df.withColumn("_r", similarity.similarities(ra, rb, ["ratio", "token_set"])).withColumn("_c", similarity.similarities(ca, cb, ["ratio"]))
        rooted = (ra != "") & (rb != "")
        root = F.when(rooted, F.col("_r.ratio") / 100).otherwise(values["name_ratio"])
        values |= {
            "name_jaro_winkler": name("jaro_winkler", 1.0), "addr_jaro_winkler": addr("jaro_winkler", 1.0),
            "brand_root_ratio": root, "brand_root_exact": F.when(rooted, _flag(ra == rb)).otherwise(values["name_exact_match"]), "brand_root_token_set": F.when(rooted, F.col("_r.token_set") / 100).otherwise(values["name_token_set"]),
            "compact_ratio": own(F.col("_c.ratio") / 100, (ca != "") & (cb != "")), "compact_exact": _flag((ca == cb) & (ca != "")),
            "pin_exact_match": own(_flag(both("postals") & pins), placed), "pin_mismatch_penalty": own(0.0 - pin, placed),
            "brand_addr_avg": average(root),
        }
    elif kind != "p1":
        df = df.withColumn("_c", similarity.similarities(ca, cb, ["ratio"]))
        values |= {"name_compact_ratio": own(F.col("_c.ratio") / 100, (ca != "") & (cb != "") if late else named), "pin_exact_match": own(pin, placed)}
    return df.select(*keep, *[values[c].alias(c) for c in VECTORS[kind]])
