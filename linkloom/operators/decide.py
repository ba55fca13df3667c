"""From scores to links: thresholds, exclusive owners, gates and patches. Rows: q_id (owner), doc_id (record), p."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accept(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("p") >= threshold)


def max_claimer(df: DataFrame) -> DataFrame:
    """Each record for its owner with the highest p, the smallest owner id on ties."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("p"), F.asc("q_id"))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def drop_contested(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where("_n = 1").drop("_n")


def with_margin(df: DataFrame, margin: float) -> DataFrame:
    """Each record for its best owner, if that leads the next by the margin at least."""
    order, whole = Window.partitionBy("doc_id").orderBy(F.desc("p"), F.asc("q_id")), Window.partitionBy("doc_id")
    out = df.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.coalesce(F.max(F.when(F.col("_n") == 2, F.col("p"))).over(whole), F.lit(0.0)))
    return out.where((F.col("_n") == 1) & (F.round(F.col("p") - F.col("_next"), 6) >= margin)).drop("_n", "_next")


def soft_owner(df: DataFrame) -> DataFrame:
    """Posterior of exclusive ownership from the odds: o / (1 + sum of o)."""
    odds = F.col("p") / (1 - F.col("p"))
    return df.withColumn("posterior", F.round(odds / (1 + F.sum(odds).over(Window.partitionBy("doc_id"))), 6))


def no_match_gate(df: DataFrame, least: float) -> DataFrame:
    """Owners whose best p, or whose only candidate's p, stays under least lose all candidates."""
    return df.withColumn("_best", F.max("p").over(Window.partitionBy("q_id"))).where(F.col("_best") >= least).drop("_best")


def veto(df: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Without the unwanted links, but no owner that had links loses its last one."""
    keep = df.join(unwanted.select("q_id", "doc_id").withColumn("_bad", F.lit(True)), ["q_id", "doc_id"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    left = F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(Window.partitionBy("q_id"))
    return keep.withColumn("_left", left).where((F.col("_left") == 0) | ~F.col("_bad")).drop("_bad", "_left")


def blend(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """The weighted mean of both p, 0 where one is missing, to six places.

    The mean of values of six places ends in a 5 often. round(x, 6) of Spark looks at the shortest decimal of x there, SQL
    elsewhere at x * 1e6: so does this, a half away from zero.
    """
    left, right = a.select("q_id", "doc_id", F.col("p").alias("pa")), b.select("q_id", "doc_id", F.col("p").alias("pb"))
    mean = weight * F.coalesce("pa", F.lit(0.0)) + (1 - weight) * F.coalesce("pb", F.lit(0.0))
    return left.join(right, ["q_id", "doc_id"], "full").select("q_id", "doc_id", (F.round(mean * 1e6) / 1e6).alias("p"))


def threshold_grid(scored: DataFrame, truth: DataFrame, owners: DataFrame, grid: list[float]) -> DataFrame:
    """Macro F0.5 at each threshold: the grid is a short list that each scored row meets by an explode."""
    from linkloom.operators.metrics import f05

    marked = scored.join(truth.select("q_id", "doc_id").withColumn("hit", F.lit(1)), ["q_id", "doc_id"], "left")
    at = F.explode(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.col("p") >= t))
    pred = marked.withColumn("th", at).groupBy("th", "q_id").agg(F.count("*").alias("pred"), F.count("hit").alias("tp"))
    gt = truth.groupBy("q_id").agg(F.count("*").alias("gt"))
    frame = owners.select("q_id").join(gt, "q_id", "left").withColumn("th", F.explode(F.array(*[F.lit(t) for t in grid])))
    every = frame.join(pred, ["th", "q_id"], "left").fillna(0, ["gt", "pred", "tp"])
    return every.groupBy("th").agg(F.round(F.avg(f05()), 6).alias("macro_f05"))


def expected_f05_size(probabilities: list[float]) -> tuple[int, float]:
    """How many of the best candidates to take, so that the expected F0.5 is largest under independent matches."""
    p = sorted(probabilities, reverse=True)

    def counts(values: list[float]) -> list[float]:
        return reduce(lambda d, x: [a * (1 - x) + b * x for a, b in zip([*d, 0.0], [0.0, *d], strict=True)], values, [1.0])

    best = (0, counts(p)[0])
    for k in range(1, len(p) + 1):
        taken, rest = counts(p[:k]), counts(p[k:])
        value = sum(a * b * 1.25 * i / (0.25 * (i + j) + k) for i, a in enumerate(taken) if i for j, b in enumerate(rest))
        if value > best[1] + 1e-12:
            best = (k, value)
    return best


def expected_f05_sets(df: DataFrame) -> DataFrame:
    """Per owner the chosen number of candidates and its expected F0.5. An owner's candidates are a bounded pool."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k, value = expected_f05_size(pdf["p"].tolist())
        return pd.DataFrame({"q_id": [pdf["q_id"].iloc[0]], "k": [k], "expected": [round(value, 6)]})

    return df.groupBy("q_id").applyInPandas(one, "q_id long, k int, expected double")
