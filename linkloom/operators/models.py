"""Two-stage scoring with MLlib: folds by owner keep the second stage free of leaks."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_of(owner: str, folds: int):
    return F.pmod(F.xxhash64(owner, F.lit(42)), F.lit(folds)).cast("int")


def _fit(df: DataFrame, features: list[str], label: str, kind: str, trees: int = 5, depth: int = 3, seed: int = 3):
    rows = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(df)
    if kind == "logistic":
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(rows)
        model = LogisticRegression(featuresCol="z", labelCol=label, maxIter=20).fit(scaler.transform(rows))
        return lambda d: model.transform(scaler.transform(VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(d)))
    model = GBTClassifier(featuresCol="x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05 if trees > 20 else 0.1, subsamplingRate=0.8, seed=seed).fit(rows)
    return lambda d: model.transform(VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(d))


def out_of_fold(df: DataFrame, features: list[str], label: str, owner: str, name: str, folds: int = 3, kind: str = "logistic") -> DataFrame:
    """Adds a probability that comes from a model without the row's owner. The loop runs over folds, not rows."""
    marked, parts = df.withColumn("_fold", fold_of(owner, folds)), []
    for k in range(folds):
        score = _fit(marked.where(F.col("_fold") != k), features, label, kind)
        parts.append(score(marked.where(F.col("_fold") == k)).withColumn(name, F.element_at(vector_to_array("probability"), 2)).select(*df.columns, name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def isotonic(df: DataFrame, score: str, label: str, name: str) -> DataFrame:
    rows = VectorAssembler(inputCols=[score], outputCol="x").transform(df)
    return IsotonicRegression(featuresCol="x", labelCol=label, predictionCol=name).fit(rows).transform(rows).drop("x")


def gradient_boosting(df: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 5, seed: int = 3):
    """The base scorer: 300 trees of at most 32 leaves, step .05, four fifths of the rows a tree. A fitted MLlib model."""
    rows = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(df)
    return GBTClassifier(featuresCol="x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed).fit(rows)


def feature_gain(model, features: list[str]) -> dict[str, float]:
    """Each feature's share of the gain of all splits."""
    return dict(zip(features, model.featureImportances.toArray().tolist(), strict=True))


def leave_one_out(df: DataFrame, features: list[str], label: str, by: str, name: str, kind: str = "logistic") -> DataFrame:
    """Adds the score of a model that has seen all partitions but the row's own. The loop runs over partitions, not rows."""
    out = None
    for value in [r[0] for r in df.select(by).distinct().orderBy(by).collect()]:
        score = _fit(df.where(F.col(by) != value), features, label, kind)
        part = score(df.where(F.col(by) == value)).withColumn(name, F.element_at(vector_to_array("probability"), 2)).select(*df.columns, name)
        out = part if out is None else out.unionByName(part)
    return out


def learning_curve(df: DataFrame, features: list[str], label: str, owner: str, shares: list[float], kind: str = "logistic") -> dict[float, float]:
    """Log loss on a fifth of the owners of models fitted on growing shares of the others, by a hash of the owner."""
    place = F.pmod(F.xxhash64(owner, F.lit(9)), F.lit(1000))
    test, out = df.where(place >= 800), {}
    for share in shares:
        score = _fit(df.where(place < 800 * share), features, label, kind)(test)
        p = F.element_at(vector_to_array("probability"), 2)
        out[share] = score.agg(F.avg(-F.col(label) * F.log(F.greatest(p, F.lit(1e-9))) - (1 - F.col(label)) * F.log(F.greatest(1 - p, F.lit(1e-9))))).first()[0]
    return out


def seed_stability(df: DataFrame, features: list[str], label: str, seeds: list[int], trees: int = 5, depth: int = 3) -> float:
    """The largest difference of a row's score between two seeds of the boosted trees."""
    rows, names = df, []
    for seed in seeds:
        score = _fit(df, features, label, "gbt", trees, depth, seed)
        names.append(f"_p{seed}")
        rows = score(rows).withColumn(names[-1], F.element_at(vector_to_array("probability"), 2)).drop("x", "rawPrediction", "probability", "prediction")
    return rows.agg(F.max(F.greatest(*names) - F.least(*names))).first()[0]


def run_arms(df: DataFrame, arms: dict[str, list[str]], label: str, owner: str, score) -> dict[str, float]:
    """Scores of several sets of features, out of fold: score(rows with column p_arm) gives the figure of each arm."""
    return {name: score(out_of_fold(df, features, label, owner, "p_arm")) for name, features in arms.items()}
