"""Commands around the linking: caches, training, tuning, and the check of result files.

    python -m tessera.plans.commands preprocess --data-dir D --cache-dir C
    python -m tessera.plans.commands train --data-dir D --model-dir M [--profile v6] [--sample-train n] [--n-estimators n] ...
    python -m tessera.plans.commands tune --data-dir D [--profile v6] [--sample-train n]
    python -m tessera.plans.commands validate [-m file] [-c file] [-t folder] [--check-ids]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import validate
from tessera.operators.blocking import PROFILES
from tessera.plans import link
from tessera.sources import records


def _training(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The training records and their true pairs; --sample-train takes so many queries, the first by id."""
    s1 = records.read_records(spark, f"{a.data_dir}/train_source1.tsv", a.sample_train)
    raw = records.targets(s1, *[records.read_records(spark, f"{a.data_dir}/train_source{k}.tsv") for k in (2, 3)])
    truth = records.read_match_lists(spark, f"{a.data_dir}/train_ground_truth.tsv").select("s1_id", F.explode("ids").alias("tgt_id"))
    return raw, truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")


def _preprocess(spark: SparkSession, a: argparse.Namespace) -> int:
    done = records.preprocess_all(spark, a.data_dir, a.cache_dir)
    print(f"written: {', '.join(done) or 'nothing'}")
    return 0 if done else 1


def _train(spark: SparkSession, a: argparse.Namespace) -> int:
    profile = PROFILES[a.profile]
    given = {"rounds": a.n_estimators, "depth": a.max_depth, "rate": a.lr}
    fitted, _ = link.fit(*_training(spark, a), profile, **(link.learner(profile) | {k: v for k, v in given.items() if v is not None}))
    fitted.write().overwrite().save(a.model_dir)
    return 0


def _tune(spark: SparkSession, a: argparse.Namespace) -> int:
    for row in link.tune(*_training(spark, a), PROFILES[a.profile]):
        print(row)
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    ids = lambda k: records.read_ids(records.read_records(spark, f"{a.test_dir}/test_source{k}.tsv"))
    known = ids(2).unionByName(ids(3)).withColumnRenamed("entity_id", "tgt_id") if a.check_ids else None
    code, told = validate.validate_files(spark, a.matching, a.candidate, ids(1).withColumnRenamed("entity_id", "s1_id"), known)
    for r in told.orderBy("rule").collect() if told is not None else []:
        print(f"{r.severity} {r.rule}: {r.n} ({r.examples})")
    print("passed" if code == 0 else "failed" if told is not None else "failed: a file is missing or empty, or its header is wrong")
    return code


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)
    each = {name: commands.add_parser(name) for name in ("preprocess", "train", "tune", "validate")}
    for name in ("preprocess", "train", "tune"):
        each[name].add_argument("--data-dir", required=True)
    each["preprocess"].add_argument("--cache-dir", required=True)
    for name in ("train", "tune"):
        each[name].add_argument("--profile", default="v6", choices=sorted(PROFILES))
        each[name].add_argument("--sample-train", type=int)
    each["train"].add_argument("--model-dir", required=True)
    for flag, kind in (("--n-estimators", int), ("--max-depth", int), ("--lr", float)):
        each["train"].add_argument(flag, type=kind)
    each["validate"].add_argument("-m", "--matching", default="output/matching_results.tsv")
    each["validate"].add_argument("-c", "--candidate", default="output/candidate_pairs.tsv")
    each["validate"].add_argument("-t", "--test-dir", default="dataset/test")
    each["validate"].add_argument("--check-ids", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"tessera-{a.command}").getOrCreate()
    return {"preprocess": _preprocess, "train": _train, "tune": _tune, "validate": _validate}[a.command](spark, a)


if __name__ == "__main__":
    raise SystemExit(main())
