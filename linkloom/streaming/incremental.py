"""Beyond batch matching: arriving records against a static index, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_arriving(records: DataFrame, tokens: Column, index: DataFrame) -> DataFrame:
    """Stream-static join of records (q_id, ...) with bm25_index() postings; rows (q_id, doc_id, weight) for an aggregate."""
    return records.select("q_id", F.explode(F.array_distinct(tokens)).alias("token")).join(index, "token").select("q_id", "doc_id", "weight")


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
