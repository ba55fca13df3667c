"""Feature blocks of candidate pairs as named columns. Records are parsed once each and joined to the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim


def name_block(a: Column, b: Column, ta: Column, tb: Column) -> list[Column]:
    """Of two normalised names and their token arrays."""
    return [
        F.round(sim.edit_similarity(a, b), 6).alias("name_lev"), F.round(sim.jaccard(ta, tb), 6).alias("name_jaccard"), F.round(sim.overlap(ta, tb), 6).alias("name_overlap"),
        F.abs(F.length(a) - F.length(b)).alias("len_diff"), F.round(sim.length_ratio(a, b), 6).alias("len_ratio"),
    ]


def provenance_block(rank_a: Column, rank_b: Column) -> list[Column]:
    """Of two retrieval ranks with 999 for absent."""
    inv = lambda r: F.when(r < 999, 1 / r).otherwise(F.lit(0.0))
    return [
        F.least(rank_a, F.lit(51)).alias("rank_a_capped"), F.least(rank_b, F.lit(11)).alias("rank_b_capped"),
        F.round(F.when(rank_a <= 50, (51 - rank_a) / 50).otherwise(0.0), 6).alias("pct_a"), F.round(F.when(rank_b <= 10, (11 - rank_b) / 10).otherwise(0.0), 6).alias("pct_b"),
        F.when((rank_a < 999) & (rank_b < 999), 1).otherwise(0).alias("both"), F.round(inv(rank_a) + inv(rank_b), 6).alias("inv_sum"), F.round(F.abs(inv(rank_a) - inv(rank_b)), 6).alias("inv_diff"),
    ]


def shared_idf_block(pairs: DataFrame, left: DataFrame, right: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Sum, mean, max, min and count of the idf of tokens that both sides hold, and the share of the left side's sum.

    left: q_id, token; right: doc_id, token (distinct rows); idf_table: token, idf.
    """
    weighted = left.join(idf_table, "token")
    total = weighted.groupBy("q_id").agg(F.sum("idf").alias("total"))
    shared = pairs.join(weighted, "q_id").join(right, ["doc_id", "token"])
    out = shared.groupBy("q_id", "doc_id").agg(F.sum("idf").alias("s"), F.avg("idf").alias("a"), F.max("idf").alias("hi"), F.min("idf").alias("lo"), F.count("*").alias("n"))
    out = pairs.join(out, ["q_id", "doc_id"], "left").join(total, "q_id", "left").fillna(0, ["s", "a", "hi", "lo", "n", "total"])
    r = lambda c, name: F.round(c, 6).alias(name)
    return out.select("q_id", "doc_id", r(F.col("s"), "idf_sum"), r(F.col("a"), "idf_mean"), r(F.col("hi"), "idf_max"), r(F.col("lo"), "idf_min"), r(F.col("s") / F.greatest(F.col("total"), F.lit(1e-5)), "idf_ratio"), F.col("n").alias("n_shared"))


def number_block(na: Column, nb: Column) -> list[Column]:
    """Of two arrays of numbers (digit strings without leading zeros); -1 where a value is undefined."""
    from linkloom.functions.text import longest

    own = longest(na)
    as_number = lambda s: F.substring(s, 1, 15).cast("long")
    gaps = F.transform(nb, lambda x: F.abs(as_number(x) - as_number(own)))
    none = own.isNull() | (F.size(nb) == 0)
    within = F.exists(nb, lambda x: x.contains(own) | own.contains(x))
    status = F.when(own.isNull(), 0).when(F.size(nb) == 0, 2).when(F.array_contains(nb, own), 3).when(within, 4).otherwise(5)
    digits = lambda s: F.array_join(F.array_sort(F.split(s, "")), "")
    swapped = F.exists(nb, lambda x: (x != own) & (digits(x) == digits(own)))
    near = F.exists(nb, lambda x: (F.length(x) == F.length(own)) & F.abs(as_number(x) - as_number(own)).between(1, 50))
    return [
        F.size(na).alias("n_left"), F.size(nb).alias("n_right"), F.coalesce(own, F.lit("")).alias("longest"), status.alias("status"),
        F.when(none, F.lit(-1.0)).otherwise(F.round(F.log1p(F.array_min(gaps)), 6)).alias("gap"),
        F.when(none, F.lit(-1)).otherwise(F.array_min(F.transform(nb, lambda x: F.levenshtein(x, own)))).alias("edit"),
        F.when(none, F.lit(-1)).otherwise(swapped.cast("int")).alias("swapped"), F.when(none, F.lit(-1)).otherwise(near.cast("int")).alias("near"),
        F.round(sim.jaccard(na, nb), 6).alias("number_jaccard"),
    ]


def token_block(ta: Column, tb: Column) -> list[Column]:
    """One-sided distinct tokens and their shares."""
    a, b = F.size(F.array_except(ta, tb)), F.size(F.array_except(tb, ta))
    share = lambda n, whole: F.round(F.when(F.size(F.array_distinct(whole)) == 0, 0.0).otherwise(n / F.size(F.array_distinct(whole))), 6)
    return [a.alias("only_left"), b.alias("only_right"), share(a, ta).alias("share_left"), share(b, tb).alias("share_right")]


def _surplus(ta: Column, tb: Column) -> Column:
    """Tokens that stand more often in ta than in tb, each as often as it does so."""
    count = lambda ts, t: F.size(F.filter(ts, lambda x: x == t))
    return F.flatten(F.transform(F.array_distinct(ta), lambda t: F.array_repeat(t, F.greatest(F.lit(0), count(ta, t) - count(tb, t)))))


def edit_kind(ta: Column, tb: Column) -> Column:
    """How two token arrays differ, as multisets, by one token: equal, sub, add, drop or other."""
    a, b = F.size(_surplus(ta, tb)), F.size(_surplus(tb, ta))
    return F.when((a == 0) & (b == 0), "equal").when((a == 1) & (b == 1), "sub").when((a == 0) & (b == 1), "add").when((a == 1) & (b == 0), "drop").otherwise("other")
