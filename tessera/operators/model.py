"""Pair classifiers: boosted trees, a second learner, blends, a fixed linear score, and a grid."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the fixed linear score.
LINEAR = {"name_ratio": 0.5, "name_token_set": 0.2, "addr_ratio": 0.2, "num_jaccard": 0.1}


# Rounds, depth, rate, shares of features and rows, and least rows of a leaf, by generation. Where a
# generation bounds leaves and not depth, the depth is the least that holds them: 31 in 5, 45 in 6.
LEARNERS = {
    "base": {"rounds": 400, "depth": 5, "rate": 0.08, "columns_share": 0.85, "rows_share": 0.85},
    "base17": {"rounds": 300, "depth": 5, "rate": 0.08},
    "v2": {"rounds": 300, "depth": 6, "rate": 0.08, "columns_share": 0.85, "rows_share": 0.85},
    "v3": {"rounds": 350, "depth": 6, "rate": 0.07, "columns_share": 0.85, "rows_share": 0.85},
    "v4": {"rounds": 1000, "depth": 8, "rate": 0.05, "columns_share": 0.85, "rows_share": 0.85},
    "v4_second": {"rounds": 1000, "depth": 7, "rate": 0.05},
    "stage2": {"rounds": 850, "depth": 9, "rate": 0.045, "columns_share": 0.85, "least": 25},
}
GRID = [
    {"rounds": 600, "depth": 8, "rate": 0.05, "columns_share": 0.85, "least": 30},
    {"rounds": 800, "depth": 10, "rate": 0.04, "columns_share": 0.80, "least": 20},
    {"rounds": 500, "depth": 7, "rate": 0.06, "columns_share": 0.90, "least": 50},
]
#: Thresholds that the grid tries, in hundredths.
GRID_PERCENTS = [60, 65, 68, 70, 72, 75, 78]


def train(
    df: DataFrame, columns: list[str], learner: str = "gbt", rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42,
    validation: str | None = None, columns_share: float = 1.0, rows_share: float = 0.85, least: int = 1, weight: str | None = None,
) -> PipelineModel:
    """Boosted trees ("gbt") or a forest ("rf"). validation: a boolean column whose rows stop the rounds early.
    columns_share, rows_share: what each tree looks at; least: rows that a leaf holds at least. weight: a
    column of how many rows a row stands for. The trees have no penalties on weights."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep")]
    weighted = {"weightCol": weight} if weight else {}
    if learner == "gbt":
        stages.append(GBTClassifier(featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=rows_share, featureSubsetStrategy=str(float(columns_share)), minInstancesPerNode=least, **weighted, **({"validationIndicatorCol": validation} if validation else {})))
    else:
        stages.append(RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=rounds, maxDepth=depth, seed=seed, minInstancesPerNode=least, **weighted))
    return Pipeline(stages=stages).fit(df)


def predict(model: PipelineModel, df: DataFrame, out: str = "probability_1") -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")


def blend(first: PipelineModel, second: PipelineModel, df: DataFrame, out: str = "probability_1") -> DataFrame:
    both = predict(second, predict(first, df, "_p1"), "_p2")
    return both.withColumn(out, 0.5 * F.col("_p1") + 0.5 * F.col("_p2")).drop("_p1", "_p2")


def linear(weights: dict[str, float] = LINEAR) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * F.col(name)
    return out


def load_or_train(path: str, build) -> PipelineModel:
    """The model at path; if there is none, the one that build() gives, saved there."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if "does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e) and "not exist" not in str(e).lower():
            raise
        model = build()
        model.save(path)
        return model


def grid(train_df: DataFrame, columns: list[str], configs: list[dict], evaluate) -> list[tuple[dict, float]]:
    """Each configuration with what evaluate(model) gives, in the order given; the first best wins a max()."""
    return [(c, evaluate(train(train_df, columns, **c))) for c in configs]
