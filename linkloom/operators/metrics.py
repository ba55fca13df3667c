"""Quality metrics of links (q_id, doc_id) against a truth table of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05() -> Column:
    """Of columns gt, pred, tp: 1 for an empty prediction of an empty truth, else 1.25 tp / (0.25 gt + pred)."""
    gt, pred, tp = F.col("gt"), F.col("pred"), F.col("tp")
    return F.when(gt == 0, F.when(pred == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(1.25 * tp / (0.25 * gt + pred))


def per_owner(owners: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """gt, pred, tp of every owner, also those without truth or prediction."""
    marked = links.select("q_id", "doc_id").join(truth.select("q_id", "doc_id").withColumn("hit", F.lit(1)), ["q_id", "doc_id"], "left")
    pred = marked.groupBy("q_id").agg(F.count("*").alias("pred"), F.count("hit").alias("tp"))
    gt = truth.groupBy("q_id").agg(F.count("*").alias("gt"))
    return owners.join(gt, "q_id", "left").join(pred, "q_id", "left").fillna(0, ["gt", "pred", "tp"])


def summary(rows: DataFrame) -> list[Column]:
    return [
        F.count("*").alias("owners"), F.round(F.avg(f05()), 6).alias("macro_f05"), F.sum("tp").alias("tp"), (F.sum("pred") - F.sum("tp")).alias("fp"),
        F.round(F.sum("tp") / F.greatest(F.sum("pred"), F.lit(1)), 6).alias("precision"), F.round(F.sum("tp") / F.greatest(F.sum("gt"), F.lit(1)), 6).alias("recall"),
    ]


def recall_at(pool: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Share of true links whose rank in the pool is at most k."""
    held = truth.select("q_id", "doc_id").join(pool.select("q_id", "doc_id", "rank"), ["q_id", "doc_id"], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return held.groupBy("k").agg(F.count("*").alias("links"), F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def rank_auc(df: DataFrame, score: str, label: str, buckets: int = 4096) -> DataFrame:
    """Area under the curve from average ranks, of scores between 0 and 1.

    Counts by score come first. A table of at most buckets rows then tells how many rows lie in lower buckets, and windows run
    inside a bucket each, so that no task sorts all scores.
    """
    by = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("pos")).withColumn("b", F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)))
    lower = by.groupBy("b").agg(F.sum("n").alias("rows")).withColumn("lower", F.coalesce(F.sum("rows").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by.withColumn("inside", inside).join(F.broadcast(lower.select("b", "lower")), "b").withColumn("avg_rank", F.col("lower") + F.col("inside") + (F.col("n") + 1) / 2)  # at most buckets rows
    total = ranks.agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return total.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_p"), F.round(F.avg(label), 6).alias("share"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of two pools per owner."""
    both = a.select("q_id", "doc_id", F.lit(1).alias("a")).join(b.select("q_id", "doc_id", F.lit(1).alias("b")), ["q_id", "doc_id"], "full")
    return both.groupBy("q_id").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.round(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1.0).otherwise(0.0)) / F.count("*"), 6).alias("jaccard"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links by whether they were kept, added or removed."""
    both = old.select("q_id", "doc_id", F.lit(1).alias("o")).join(new.select("q_id", "doc_id", F.lit(1).alias("n")), ["q_id", "doc_id"], "full")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("links"), F.countDistinct("q_id").alias("owners"))
