"""Censuses over pairs: number offsets, contests, unclaimed near matches, samples and synthetic records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offset_census(pairs: DataFrame, klass: str, delta: str, reach: int, shifts: list[int]) -> DataFrame:
    """Pairs by class: those at a shift, those at its mirror image, and their ratio. delta: signed number offset."""
    near = pairs.where(F.abs(F.col(delta)) <= reach)
    at = lambda s: F.sum(F.when(F.col(delta).isin(*s), 1).otherwise(0))
    out = near.groupBy(klass).agg(F.count("*").alias("n"), at(shifts).alias("n_shift"), at([-s for s in shifts]).alias("n_mirror"))
    return out.withColumn("ratio", F.round(F.col("n_shift") / F.greatest(F.col("n_mirror"), F.lit(1)), 6))


def offset_census_of_groups(records: DataFrame, group: str, row_id: str, number: str, klass: str, reach: int, shifts: list[int]) -> DataFrame:
    """offset_census() over all pairs of a group, the smaller id first, without making the pairs.

    Each record counts, by a window over (group, number), the later records at every offset within reach: a record meets at
    most 2 x reach + 1 counted numbers, however many records share one.
    """
    rows = records.select(group, F.col(row_id).alias("id"), F.col(number).alias("x"), F.col(klass).alias("k"))
    # A record of number x is asked for by records of numbers x - delta: both go to the place (group, x).
    asks = rows.withColumn("delta", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select(group, (F.col("x") + F.col("delta")).alias("at"), "id", "k", "delta", F.lit(0).alias("own"))
    both = asks.unionByName(rows.select(group, F.col("x").alias("at"), "id", "k", F.lit(0).alias("delta"), F.lit(1).alias("own")))
    later = F.sum("own").over(Window.partitionBy(group, "at").orderBy(F.col("id").desc()).rangeBetween(Window.unboundedPreceding, -1))
    counts = both.withColumn("pairs", later).where("own = 0 and pairs > 0")
    at = lambda s: F.coalesce(F.sum(F.when(F.col("delta").isin(*s), F.col("pairs"))), F.lit(0))
    out = counts.groupBy(F.col("k").alias(klass)).agg(F.sum("pairs").alias("n"), at(shifts).alias("n_shift"), at([-s for s in shifts]).alias("n_mirror"))
    return out.withColumn("ratio", F.round(F.col("n_shift") / F.greatest(F.col("n_mirror"), F.lit(1)), 6))


def contests(links: DataFrame) -> DataFrame:
    """Records that exactly two owners claim: both owners and the lead."""
    two = links.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.struct("p", (-F.col("q_id")).alias("m"))).alias("hi"), F.min(F.struct("p", (-F.col("q_id")).alias("m"))).alias("lo")).where("n = 2")
    return two.select("doc_id", (-F.col("hi.m")).alias("winner"), (-F.col("lo.m")).alias("loser"), F.round(F.col("hi.p") - F.col("lo.p"), 6).alias("lead"))


def unclaimed(pool: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Pool pairs over least whose record nobody claims."""
    return pool.where(F.col("p") >= least).join(links.select("doc_id").distinct(), "doc_id", "left_anti").select("q_id", "doc_id", "p")


def stratified_sample(df: DataFrame, strata: list[str], row_id: Column, per_stratum: int) -> DataFrame:
    """The first rows of each stratum in an order by hash: a sampling operator, the same on any machine."""
    order = Window.partitionBy(*strata).orderBy(F.md5(row_id.cast("string")), row_id)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_stratum).drop("_n")


def quota_sample(df: DataFrame, strata: list[str], row_id: Column, total: int, least: int) -> DataFrame:
    """Each stratum's share of total rows, but at least `least` (or all it has), in an order by hash: a sampling operator.

    No quota is over the larger of both numbers, so that many rows of a stratum and partition at most are shuffled; sizes are
    counted before. Null is a stratum like any other.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_c"))
    share = F.col("_c") / F.sum("_c").over(Window.partitionBy(F.lit(1)))  # one row a stratum
    quotas = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in strata], F.greatest(F.lit(least), F.round(F.lit(total) * share)).alias("_q"))
    order = Window.partitionBy(*strata).orderBy(F.md5(row_id.cast("string")), row_id)
    first = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(total, least))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata])
    return first.join(quotas, same).where("_n <= _q").select(*df.columns)


def count_prior(counts: DataFrame, stratum: str, n: str) -> DataFrame:
    return counts.groupBy(stratum).agg(F.count("*").alias("owners"), F.round(F.avg(n), 6).alias("mean_n"), F.round(F.avg(F.when(F.col(n) == 0, 1.0).otherwise(0.0)), 6).alias("share_empty"))


def synthetic_copies(records: DataFrame, copies: int = 2, seed: int = 17) -> DataFrame:
    """Noisy copies of (id, name) with a known owner: a hash of id and copy picks a token to drop, double, truncate or swap."""
    out = records.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("ts", F.split("name", " "))
    h = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(1 << 30))
    at, kind = (F.pmod(h, F.size("ts")) + 1).cast("int"), F.pmod(F.floor(h / 1000), F.lit(4))
    one = F.element_at("ts", at)
    new = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat_ws(" ", one, one)).when(kind == 2, F.left(one, F.greatest(F.lit(1), F.length(one) - 1))).otherwise(F.reverse(one))
    changed = F.transform("ts", lambda t, i: F.when(i + 1 == at, new).otherwise(t))
    return out.select("id", "copy", F.array_join(F.filter(changed, lambda t: t != ""), " ").alias("name"))
