"""Readers and writers of record tables, truth lists and result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "entity_id string, business_name string, business_address string, country string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, country: str | None = None) -> DataFrame:
    """Tab-separated records (gzip too), short rows padded with empty strings; the partition filter reaches the scan."""
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", mode="PERMISSIVE").na.fill("")
    return rows if country is None else rows.where(F.col("country") == country)


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Links (q_id, doc_id) from a key and a comma list; keys without a match stay with a null doc_id."""
    rows = spark.read.csv(path, schema="q_id string, matched string", sep="\t", header=True, quote="")
    listed = F.filter(F.split(F.coalesce("matched", F.lit("")), ","), lambda x: x != "")
    return rows.select("q_id", F.explode_outer(listed).alias("doc_id"))


def rows_of(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def missing(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(table, key, "left_anti")


def link_lists(owners: DataFrame, links: DataFrame) -> DataFrame:
    """One row an owner: its sorted comma list, empty without links."""
    lists = links.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("matched"))
    return owners.select("q_id").join(lists, "q_id", "left").fillna("", ["matched"])


def write_tsv(df: DataFrame, path: str, partition_by: str | None = None, compression: str = "none") -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("compression", compression)
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def replace_partition(base: DataFrame, other: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of one partition from other, all others from base."""
    return base.where(F.col(column) != value).unionByName(other.where(F.col(column) == value))


def problems(owners: DataFrame, lists: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Checks of a result table (q_id, matched) as rows (rule, n): one row a rule, n = 0 if it holds."""
    links = lists.select("q_id", F.explode(F.filter(F.split("matched", ","), lambda x: x != "")).alias("doc_id"))
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    checks = [
        count(lists.groupBy("q_id").count().where("count > 1"), "duplicate owner"),
        count(owners.join(lists, "q_id", "left_anti"), "missing owner"),
        count(lists.join(owners, "q_id", "left_anti"), "unknown owner"),
        count(links.groupBy("q_id", "doc_id").count().where("count > 1"), "duplicate link"),
        count(links.join(records, "doc_id", "left_anti"), "unknown record"),
        count(links.join(candidates, ["q_id", "doc_id"], "left_anti"), "link outside the candidates"),
        count(links.groupBy("doc_id").agg(F.countDistinct("q_id").alias("n")).where("n > 1"), "record with two owners"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.union(check)
    return out


def ordered_lists(owners: DataFrame, pool: DataFrame, score: str, name: str) -> DataFrame:
    """One row an owner: its candidates by falling score, then id, as a comma list."""
    lists = pool.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "doc_id"))).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda x: x["doc_id"].cast("string")), ",")
    return owners.select("q_id").join(lists.select("q_id", joined.alias(name)), "q_id", "left").fillna("", [name])


def emptied(lists: DataFrame, where: Column) -> DataFrame:
    """Result lists with those of one partition emptied, to probe what it is worth."""
    return lists.withColumn("matched", F.when(where, "").otherwise(F.col("matched")))


def materialise_by(df: DataFrame, path: str, key: str, values: list[str]) -> DataFrame:
    """Writes a table one partition value after the other and skips those that are there whole, so that a stopped run goes on
    where it was. A partition counts as whole once its success mark is written."""
    from urllib.parse import quote

    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for value in values:
        place = f"{path}/{key}={quote(value, safe='')}"
        mark = hadoop.Path(f"{place}/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            df.where(F.col(key) == value).drop(key).write.mode("overwrite").parquet(place)
    return spark.read.option("basePath", path).parquet(*[f"{path}/{key}={quote(v, safe='')}" for v in values])
