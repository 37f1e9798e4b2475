"""End to end: records to match lists, by a rule or by a model, and a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators import blocking, decide, features, metrics, model, sampling
from tessera.operators.blocking import PROFILES, Profile
from tessera.sources import records


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("src = 'S1'"), df.filter("src <> 'S1'")


def resolve_by_rule(raw: DataFrame, profile: Profile, least: float) -> DataFrame:
    """s1_id, ids: candidates whose names' Jaro-Winkler similarity is `least` or more, capped by source."""
    s1, tgt = split(records.preprocess(raw))
    pairs = features.pairs(blocking.candidates(s1, tgt, profile).select("s1_id", "tgt_id"), s1, tgt)
    scored = pairs.withColumn("s", similarity.similarities(F.col("a_c_name"), F.col("b_c_name"), ["jaro_winkler"])).filter(F.col("s.jaro_winkler") >= least)
    ranked = decide.capped(scored.select("s1_id", "tgt_id", F.round("s.jaro_winkler", 9).alias("score")), dict(zip(("S2", "S3"), profile.caps, strict=True)))
    return decide.match_lists(ranked, s1)


def learner(profile: Profile) -> dict:
    """The parameters of the generation's boosted trees."""
    same = {"high_recall": "base", "v3fast": "v3", "v5": "v4", "v6": "stage2", "stage1": "stage2"}
    return model.LEARNERS[same.get(profile.name, profile.name)]


def fit(raw: DataFrame, truth: DataFrame, profile: Profile, kind: str = "p4", negatives: int | None = None, **params) -> tuple:
    """A model, and the labelled feature rows of the held-out queries."""
    s1, tgt = split(records.preprocess(raw))
    found = blocking.candidates(s1, tgt, profile)
    pairs = sampling.labelled(found, truth) if negatives is None else sampling.labelled(sampling.capped_negatives(found, truth, negatives), truth)
    rows = sampling.group_split(features.features(features.pairs(pairs, s1, tgt), kind, ("s1_id", "tgt_id", "label")), F.col("s1_id"))
    return model.train(rows.filter("not is_validation"), features.VECTORS[kind], **params), rows.filter("is_validation")


def resolve(raw: DataFrame, fitted, profile: Profile, kind: str = "p4", threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Match lists and candidate lists of all queries: blocking, features, probability, threshold, guards, caps. fitted: a
    model, or a score as an expression over the features."""
    s1, tgt = split(records.preprocess(raw))
    found = blocking.candidates(s1, tgt, profile)
    ranked = scored(found, s1, tgt, fitted, profile, kind).filter(F.col("score") >= (profile.threshold if threshold is None else threshold))
    return decide.match_lists(ranked, s1), decide.match_lists(found, s1)


def scored(found: DataFrame, s1: DataFrame, tgt: DataFrame, fitted, profile: Profile, kind: str) -> DataFrame:
    """s1_id, tgt_id, score, rank of candidates after guards and caps, before any threshold. A threshold keeps the best of
    each query, so that it may come before the caps or after them."""
    rows = features.features(features.pairs(found.select("s1_id", "tgt_id"), s1, tgt), kind, ("s1_id", "tgt_id", "a_numbers", "b_numbers", "a_postals", "b_postals"))
    rows = rows.withColumn("score", fitted) if isinstance(fitted, Column) else model.predict(fitted, rows, "score")
    return decide.capped(decide.guarded(rows, 100 * F.col("name_ratio")), dict(zip(("S2", "S3"), profile.caps, strict=True)))


def tune(raw: DataFrame, truth: DataFrame, profile: Profile, configs: list[dict] = model.GRID, percents: list[int] = model.GRID_PERCENTS, kind: str = "p3", negatives: int = 4, mine_k: int = 10) -> list[dict]:
    """Each configuration with its best threshold and the macro F0.5 there of held-out queries, end to end, best first. It
    learns from the other queries' true pairs and their first wrong candidates."""
    s1, tgt = split(records.preprocess(raw))
    s1 = sampling.group_split(s1, F.col("entity_id"))
    learn, held = s1.filter("not is_validation"), s1.filter("is_validation")
    pairs = sampling.mined(blocking.candidates(learn, tgt, profile, mine_k), truth.join(learn.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi"), learn, tgt, negatives)
    rows = features.features(features.pairs(pairs, learn, tgt), kind, ("s1_id", "tgt_id", "label"))
    found, queries = blocking.candidates(held, tgt, profile), held.select(F.col("entity_id").alias("s1_id"))
    right = truth.join(queries, "s1_id", "left_semi")
    out = []
    for config in configs:
        told = calibrate(scored(found, held, tgt, model.train(rows, features.VECTORS[kind], **config), profile, kind), right, queries, percents)
        best = told.filter("is_best").first()
        out.append({**config, "threshold": best.threshold / 100, "macro_f05": best.macro_f05})
    return sorted(out, key=lambda r: -r["macro_f05"])


def calibrate(scored: DataFrame, truth: DataFrame, queries: DataFrame, percents: list[int]) -> DataFrame:
    """The sweep over thresholds given in hundredths, for scored pairs (s1_id, tgt_id, score from 0 to 1)."""
    return metrics.threshold_sweep(queries, truth, scored.withColumn("score", 100 * F.col("score")), percents)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Link the records of several TSV sources.")
    p.add_argument("--data-dir", required=True, help="holds test_source1.tsv to test_source3.tsv, and train_ ones with train_ground_truth.tsv")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--model-dir", required=True)
    p.add_argument("--profile", default="v6", choices=sorted(PROFILES))
    p.add_argument("--threshold", type=float)
    p.add_argument("--country", help="link one country's records only; its lists go to a folder of their own")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera-link").getOrCreate()
    profile = PROFILES[a.profile]
    read = lambda part: records.targets(*[records.read_records(spark, f"{a.data_dir}/{part}_source{k}.tsv") for k in (1, 2, 3)])

    def build():
        lists = records.read_match_lists(spark, f"{a.data_dir}/train_ground_truth.tsv")
        return fit(read("train"), lists.select("s1_id", F.explode("ids").alias("tgt_id")), profile, **learner(profile))[0]

    raw = read("test")
    if a.country:
        raw = raw.filter(F.col("country") == a.country)
    matches, candidates = resolve(raw, model.load_or_train(a.model_dir, build), profile, threshold=a.threshold)
    out = f"{a.output_dir}/country={a.country}" if a.country else a.output_dir
    records.write_match_lists(matches, f"{out}/matching_results")
    records.write_match_lists(candidates, f"{out}/candidate_pairs", records.CANDIDATES)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
