"""Per-group competition features as window functions. Ties are broken by the larger score, then the smaller id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def competition(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Where each item stands among those of its group."""
    whole, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    out = df.withColumn("pos", F.row_number().over(order)).withColumn("k", F.count("*").over(whole)).withColumn("top", F.max(score).over(whole))
    out = out.withColumn("second", F.coalesce(F.max(F.when(F.col("pos") == 2, F.col(score))).over(whole), F.lit(0.0)))
    over = lambda t: F.sum(F.when(F.col(score) > t, 1).otherwise(0)).over(whole)
    return out.select(
        group, item, score, "pos", F.round("top", 6).alias("top"), F.round("second", 6).alias("second"),
        F.round(F.when(F.col("k") == 1, 1.0).otherwise((F.col("k") - F.col("pos")) / (F.col("k") - 1)), 6).alias("pct"),
        F.round(F.col(score) - F.col("second"), 6).alias("to_second"), F.round(F.col(score) - F.col("top"), 6).alias("to_top"),
        over(0.8).alias("n80"), over(0.7).alias("n70"), over(0.9).alias("n90"),
        F.round(F.stddev_pop(score).over(whole), 6).alias("std"), F.round(F.avg(score).over(whole), 6).alias("mean"),
    )


def runner_up(df: DataFrame, item: str, owner: str, score: str) -> DataFrame:
    """The best score that another owner of the same item has, 0 without one."""
    whole, order = Window.partitionBy(item), Window.partitionBy(item).orderBy(F.desc(score), F.asc(owner))
    out = df.withColumn("pos", F.row_number().over(order))
    first, second = (F.max(F.when(F.col("pos") == n, F.col(score))).over(whole) for n in (1, 2))
    return out.select(item, owner, score, F.coalesce(F.when(F.col("pos") == 1, second).otherwise(first), F.lit(0.0)).alias("rival"))


def normalised_mass(df: DataFrame, item: str, score: str) -> DataFrame:
    total = F.sum(score).over(Window.partitionBy(item))
    return df.withColumn("mass", F.round(F.col(score) / F.greatest(F.lit(1.0), total), 6))


def support(df: DataFrame, group: str, field: str) -> DataFrame:
    """Other rows of the group that agree, and that differ, in the field."""
    same, whole = F.count("*").over(Window.partitionBy(group, field)), F.count("*").over(Window.partitionBy(group))
    return df.withColumns({"n_agree": same - 1, "n_differ": whole - same})
