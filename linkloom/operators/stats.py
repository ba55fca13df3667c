"""Corpus statistics and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (1000, "101-1000"))


def token_df(docs: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """Documents that hold each token, by the given columns."""
    return docs.select(*by, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def size_bin(n: Column) -> Column:
    out = None
    for most, name in BINS:
        out = F.when(n <= most, name) if out is None else out.when(n <= most, name)
    return out.otherwise("1000+")


def frequency_buckets(counts: DataFrame) -> DataFrame:
    """Keys and rows by bin of the key's frequency n."""
    return counts.groupBy(size_bin(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


def uniqueness_profile(counts: DataFrame, key: str) -> DataFrame:
    over = lambda least: F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0)).alias(f"rows_ge{least}")
    return counts.agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n_rows"), F.round(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.count("*"), 6).alias("share_unique"),
        F.max("n").alias("max_n"), F.max_by(key, F.struct("n", key)).alias("top_key"), over(2), over(10), over(100),
    )


def duplicate_groups(df: DataFrame, key: str, row_id: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id")).where("n > 1")


def binned_mutual_information(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Bits, over bins x bins cells of equal width."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1)).alias(f"b_{c}")
    both = df.crossJoin(F.broadcast(ends)).select(cell(x), cell(y)).groupBy(f"b_{x}", f"b_{y}").agg(F.count("*").alias("n"))  # ends: one row
    both = both.withColumns({"nx": F.expr(f"sum(n) over (partition by b_{x})"), "ny": F.expr(f"sum(n) over (partition by b_{y})")})
    total = both.agg(F.sum("n").alias("t"))
    return both.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))), 6).alias("bits"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, and a sum of row hashes that no order changes."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint"))


def vocabulary_tails(names: DataFrame, tokens: Column, least: int) -> DataFrame:
    """Last tokens that close at least so many names."""
    return names.where(F.size(tokens) > 0).groupBy(F.element_at(tokens, -1).alias("tail")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation; equal values share their mean rank. Counts by value come first."""
    out = df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    for c in "xy":
        n = out.groupBy(c).agg(F.count("*").alias("n"))
        ranks = numbered(n, [F.col(c)], None, "n").select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))
        out = out.join(ranks, c)
    return out.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def numbered(df: DataFrame, order: list[Column], by: str | None, weight: str | None = None) -> DataFrame:
    """Rows with their place in a whole order (or, as upto, the weights up to them).

    Rows are numbered inside ranges of the order's first column, or of 200 buckets of its quantiles without one, and each range adds
    the counts of the ranges before it: no task sorts the whole table.
    """
    first = order[0] if by is None else F.col(by)
    value = F.lit(1) if weight is None else F.col(weight)
    if by is None:
        ends = sorted(set(df.agg(F.percentile_approx(first, [k / 200 for k in range(1, 200)], F.lit(10000)).alias("q")).first()["q"] or []))
        bucket = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: first > e)) if ends else F.lit(0)
    else:
        bucket = first
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.sum(value).alias("_n")).withColumn("_lower", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    name = "place" if weight is None else "upto"
    return rows.withColumn("_i", inside).join(sizes.select("_b", "_lower"), "_b").withColumn(name, F.col("_i") + F.col("_lower")).drop("_b", "_i", "_lower")


def manifest(df: DataFrame) -> DataFrame:
    """Rows, and an exclusive or of the rows' md5 that no order changes, as a written table's check."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(head).cast("string").alias("fingerprint"))
