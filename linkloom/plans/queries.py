"""The named queries over the driver's tables. linkloom.plans.oracles holds the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions import text as tx
from linkloom.operators import census, decide, features, metrics, models, retrieval, stats, windows
from linkloom.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K, MAX_DF_SHARE = 5, 0.1
GRID = [round(0.1 + 0.02 * k, 2) for k in range(43)]
EVENTS = ("click", "error", "purchase", "signup", "view")
SHIFTS = [1, 2, 3, 4, 5, 7, 9, 11, 13, 21]  # fixed values: the offsets of the mirror census


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def items(spark, d) -> DataFrame:
    return src.read_table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), "text")


def docs(spark, d) -> DataFrame:
    return src.read_table(spark, d, "documents").select(F.col("lang").alias("part"), "doc_id", "text")


def stems(text):
    """The tokens of the second channel: words of four letters and more, by their first five letters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1))
    return F.transform(found, lambda t: F.left(t, F.lit(5)))


def index(spark, d) -> DataFrame:
    return retrieval.bm25_index(docs(spark, d), tx.ascii_tokens(F.col("text")), max_df_share=MAX_DF_SHARE)


def with_p(pool: DataFrame) -> DataFrame:
    return pool.withColumn("p", F.round(F.col("score") / (F.col("score") + 20), 6))


def pool(spark, d) -> DataFrame:
    return with_p(retrieval.bm25_topk(items(spark, d), tx.ascii_tokens(F.col("text")), index(spark, d), K))


def name_pool(spark, d) -> DataFrame:
    at = retrieval.bm25_index(docs(spark, d), stems(F.col("text")), max_df_share=MAX_DF_SHARE)
    return retrieval.bm25_topk(items(spark, d), stems(F.col("text")), at, 3)


def truth(spark, d) -> DataFrame:
    """Documents that hold at least 0.6 of an item's distinct tokens."""
    return retrieval.containment(items(spark, d), tx.ascii_tokens(F.col("text")), docs(spark, d), tx.ascii_tokens(F.col("text")), 0.6)


def parts(spark, d) -> DataFrame:
    """Clean and noisy name records: part names, the noisy side with another key."""
    return src.read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))


def name_pairs(spark, d) -> DataFrame:
    """Distinct names that become siblings by one deleted token, with both names."""
    names = parts(spark, d).groupBy("name").agg(F.min("id").alias("id"))
    pairs = retrieval.deletion_siblings(names, tx.deletion_keys(tx.ascii_tokens(F.col("name"))))
    return pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")


@query
def normalized_text(spark, d):
    return src.read_table(spark, d, "conversations").select("conv_id", "turn", tx.normalise(F.col("text")).alias("norm"), tx.normalise(F.col("text"), True).alias("norm_marks"))


@query
def token_df(spark, d):
    return stats.token_df(docs(spark, d), tx.ascii_tokens(F.col("text")), "part")


@query
def idf_table(spark, d):
    rows = docs(spark, d)
    df = stats.token_df(rows, tx.ascii_tokens(F.col("text")))
    return df.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("token", "df", F.round(stats.idf(F.col("n"), F.col("df")), 6).alias("idf"))  # one row


@query
def name_freq_profile(spark, d):
    return stats.uniqueness_profile(stats.frequency(parts(spark, d), "name"), "name")


@query
def freq_buckets(spark, d):
    return stats.frequency_buckets(stats.frequency(parts(spark, d), "name"))


@query
def grouping_profile(spark, d):
    src.read_table(spark, d, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM _documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


@query
def exact_dup_groups(spark, d):
    return stats.duplicate_groups(src.read_table(spark, d, "documents").withColumn("key", F.md5("text")), "key", "doc_id").select("key", "n", "first_id")


@query
def address_sharing_counts(spark, d):
    return src.read_table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0).select("o_custkey", *(F.col(c).alias(f"n_{c.lower()}") for c in "FOP"))


@query
def crosstab_margins(spark, d):
    src.read_table(spark, d, "part").createOrReplaceTempView("_part")
    return spark.sql("SELECT p_brand AS brand, p_type AS type, count(*) AS n FROM _part GROUP BY CUBE (p_brand, p_type)")


@query
def pivot_counts(spark, d):
    return src.read_table(spark, d, "events").groupBy("user_id").pivot("event_type", list(EVENTS)).agg(F.count(F.lit(1))).fillna(0).select("user_id", *[F.col(e).alias(f"n_{e}") for e in EVENTS])


@query
def rollup_match_coverage(spark, d):
    rows = docs(spark, d).join(truth(spark, d).select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    rows.createOrReplaceTempView("_coverage")
    return spark.sql("SELECT part, count(*) AS n, count(hit) AS n_hit FROM _coverage GROUP BY ROLLUP (part)")


@query
def mutual_information(spark, d):
    return stats.binned_mutual_information(src.read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20)


@query
def link_count_distribution(spark, d):
    counts = src.read_table(spark, d, "customer").select("c_custkey").join(src.read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").fillna(0, ["n"])
    return counts.groupBy("n").agg(F.count("*").alias("owners"))


@query
def count_prior(spark, d):
    customers = src.read_table(spark, d, "customer")
    n = src.read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return census.count_prior(customers.join(n, "c_custkey", "left").fillna(0, ["n"]), "c_mktsegment", "n")


@query
def vocabulary_tails(spark, d):
    return stats.vocabulary_tails(parts(spark, d), tx.ascii_tokens(F.col("name")), 5)


@query
def bm25_topk_lang(spark, d):
    return pool(spark, d).select("part", "q_id", "doc_id", "score", "rank")


@query
def bm25_name_channel(spark, d):
    return name_pool(spark, d).select("part", "q_id", "doc_id", "score", "rank")


@query
def bm25_char_grams(spark, d):
    names = parts(spark, d).select(F.col("brand").alias("part"), F.col("id").alias("doc_id"), "name")
    at = retrieval.bm25_index(names, tx.char_grams(F.lower("name")), max_df=5000)
    asked = parts(spark, d).groupBy("name").agg(F.min("id").alias("q_id"))
    return retrieval.bm25_topk(asked, tx.char_grams(F.lower("name")), at, 2).select("part", "q_id", "doc_id", "score", "rank")


@query
def pool_union(spark, d):
    return retrieval.pool_union(pool(spark, d), name_pool(spark, d))


@query
def capped_union(spark, d):
    a = retrieval.ranked(pool(spark, d).drop("rank"), ("q_id",), "score", "doc_id", 4)
    b = retrieval.ranked(name_pool(spark, d).drop("rank"), ("q_id",), "score", "doc_id", 4)
    return retrieval.capped_union(a, b, 6)


@query
def reverse_bm25_top1(spark, d):
    return retrieval.reverse_topk(items(spark, d), tx.ascii_tokens(F.col("text")), index(spark, d), 1).select("part", "doc_id", "q_id", "score")


@query
def containment_owner_count(spark, d):
    return truth(spark, d).groupBy("doc_id").agg(F.count("*").alias("owners"), F.max("shared").alias("max_shared"))


@query
def deletion_key_siblings(spark, d):
    return name_pairs(spark, d).select("a", "b", "key")


@query
def dense_topk_cosine(spark, d):
    v = src.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return retrieval.dense_topk(v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "q_id"), v, 5)


@query
def dense_lexical_union(spark, d):
    dense = dense_topk_cosine(spark, d).where("rank <= 3")
    label = src.read_table(spark, d, "embeddings").select("vec_id", "label")
    other = dense.select("q_id").distinct().join(label, F.col("q_id") == F.col("vec_id")).select("q_id", "label").join(label.withColumnRenamed("vec_id", "doc_id"), "label")
    return retrieval.pool_union(dense, retrieval.ranked(other.withColumn("one", F.lit(1)), ("q_id",), "one", "doc_id", 3))


@query
def shared_token_idf_block(spark, d):
    left = items(spark, d).select("q_id", F.explode(F.array_distinct(tx.ascii_tokens(F.col("text")))).alias("token"))
    right = docs(spark, d).select("doc_id", F.explode(F.array_distinct(tx.ascii_tokens(F.col("text")))).alias("token"))
    n = docs(spark, d).agg(F.count("*").alias("n"))
    idf = right.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", stats.idf(F.col("n"), F.col("df")).alias("idf"))
    return features.shared_idf_block(pool(spark, d).select("q_id", "doc_id"), left, right, idf)


@query
def retrieval_provenance_block(spark, d):
    return pool_union(spark, d).select("q_id", "doc_id", *features.provenance_block(F.col("rank_a"), F.col("rank_b")))


def _pair_texts(spark, d) -> DataFrame:
    return pool(spark, d).join(items(spark, d).withColumnRenamed("text", "ta"), "q_id").join(docs(spark, d).select("doc_id", F.col("text").alias("tb")), "doc_id")


@query
def name_similarity_block(spark, d):
    a, b = tx.normalise(F.col("name_a")), tx.normalise(F.col("name_b"))
    return name_pairs(spark, d).select("a", "b", *features.name_block(a, b, F.split(a, " "), F.split(b, " ")))


@query
def number_block_basic(spark, d):
    orders = src.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"), "o_custkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority").alias("t"))
    pairs = orders.select(F.col("id").alias("a"), "o_custkey", "p", F.col("t").alias("ta")).join(orders.select(F.col("id").alias("b"), "o_custkey", "p", F.col("t").alias("tb")), ["o_custkey", "p"]).where("a < b")
    return pairs.select("a", "b", *features.number_block(tx.numbers(F.col("ta")), tx.numbers(F.col("tb"))))


@query
def token_asymmetry_block(spark, d):
    return _pair_texts(spark, d).select("q_id", "doc_id", *features.token_block(tx.ascii_tokens(F.col("ta")), tx.ascii_tokens(F.col("tb"))))


@query
def one_token_edit_kind(spark, d):
    p = name_pairs(spark, d).select("a", "b", tx.ascii_tokens(F.col("name_a")).alias("ta"), tx.ascii_tokens(F.col("name_b")).alias("tb"))
    return p.select("a", "b", features.edit_kind(F.col("ta"), F.col("tb")).alias("kind"))


@query
def diff_token_block(spark, d):
    df = stats.token_df(parts(spark, d), tx.ascii_tokens(F.col("name")))
    p = name_pairs(spark, d).select("a", "b", tx.ascii_tokens(F.col("name_a")).alias("ta"), tx.ascii_tokens(F.col("name_b")).alias("tb"))
    p = p.select("a", "b", F.get(F.array_sort(F.array_except("ta", "tb")), F.lit(0)).alias("da"), F.get(F.array_sort(F.array_except("tb", "ta")), F.lit(0)).alias("db"))
    for side in "ab":
        p = p.join(df.select(F.col("token").alias(f"d{side}"), F.round(F.log(F.col("df")), 6).alias(f"ldf_{side}")), f"d{side}", "left")
    return p.select("a", "b", "da", "db", "ldf_a", "ldf_b")


@query
def name_keys(spark, d):
    t = tx.ascii_tokens(F.col("name"))
    return parts(spark, d).select("id", tx.core_key(t).alias("core"), tx.multiset_key(t).alias("multiset"), tx.acronym(t).alias("acronym"), F.size(tx.char_grams(F.col("name"))).alias("n_grams"))


@query
def competition_block(spark, d):
    best = pool(spark, d).groupBy("q_id", "doc_id").agg(F.max("p").alias("p"))
    return windows.competition(best, "q_id", "doc_id", "p")


@query
def runner_up_owner(spark, d):
    return windows.runner_up(pool(spark, d).select("q_id", "doc_id", "p"), "doc_id", "q_id", "p")


@query
def structural_support(spark, d):
    return windows.support(pool(spark, d).select("q_id", "doc_id", "part"), "q_id", "part")


@query
def normalised_mass(spark, d):
    return windows.normalised_mass(pool(spark, d).select("q_id", "doc_id", "p"), "doc_id", "p")


@query
def group_topk(spark, d):
    o = src.read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return retrieval.ranked(o, ("o_custkey",), "o_totalprice", "o_orderkey", 3)


def links(spark, d) -> DataFrame:
    return decide.max_claimer(decide.accept(pool(spark, d).select("q_id", "doc_id", "p"), 0.4))


@query
def max_claimer(spark, d):
    return links(spark, d)


@query
def drop_all_contested(spark, d):
    return decide.drop_contested(decide.accept(pool(spark, d).select("q_id", "doc_id", "p"), 0.4))


@query
def margin_rule(spark, d):
    return decide.with_margin(pool(spark, d).select("q_id", "doc_id", "p"), 0.05)


@query
def soft_owner_posterior(spark, d):
    return decide.soft_owner(pool(spark, d).select("q_id", "doc_id", "p"))


@query
def no_match_gate(spark, d):
    return decide.no_match_gate(pool(spark, d).select("q_id", "doc_id", "p"), 0.6)


@query
def veto_keeps_last(spark, d):
    return decide.veto(links(spark, d), links(spark, d).where("p < 0.6"))


@query
def probability_blend(spark, d):
    b = retrieval.ranked(with_p(name_pool(spark, d).drop("rank")), ("q_id", "doc_id"), "p", "part", 1)
    return decide.blend(pool(spark, d), b, 0.7)


@query
def threshold_grid(spark, d):
    return decide.threshold_grid(pool(spark, d).select("q_id", "doc_id", "p"), truth(spark, d), items(spark, d), GRID)


@query
def macro_f05(spark, d):
    rows = metrics.per_owner(items(spark, d).select("q_id"), links(spark, d), truth(spark, d))
    return rows.agg(*metrics.summary(rows))


@query
def slice_summary(spark, d):
    owners = items(spark, d).select("q_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("slice"))
    rows = metrics.per_owner(owners, links(spark, d), truth(spark, d))
    return rows.groupBy("slice").agg(*metrics.summary(rows))


@query
def recall_at_k(spark, d):
    return metrics.recall_at(pool(spark, d), truth(spark, d), [1, 2, 3, 5])


@query
def pool_oracle(spark, d):
    held = pool(spark, d).select("q_id", "doc_id").join(truth(spark, d), ["q_id", "doc_id"], "left_semi")
    rows = metrics.per_owner(items(spark, d).select("q_id"), held, truth(spark, d))
    return rows.agg(*metrics.summary(rows))


@query
def pool_jaccard(spark, d):
    return metrics.agreement(pool(spark, d).select("q_id", "doc_id"), name_pool(spark, d).select("q_id", "doc_id"))


@query
def loss_budget(spark, d):
    rows = metrics.per_owner(items(spark, d).select("q_id"), links(spark, d), truth(spark, d))
    kind = F.when(F.col("gt") == 0, F.when(F.col("pred") == 0, "right empty").otherwise("false on empty")).when(F.col("tp") == 0, "all missed").when(F.col("pred") > F.col("tp"), "some false").when(F.col("gt") > F.col("tp"), "some missed").otherwise("exact")
    return rows.groupBy(kind.alias("category")).agg(F.count("*").alias("owners"), F.round(F.sum(1 - metrics.f05()), 6).alias("loss"))


@query
def calibration_bins(spark, d):
    rows = pool(spark, d).join(truth(spark, d).select("q_id", "doc_id").withColumn("hit", F.lit(1)), ["q_id", "doc_id"], "left").fillna(0, ["hit"])
    return metrics.calibration(rows, "p", "hit", 10)


@query
def auc_rank(spark, d):
    rows = pool(spark, d).join(truth(spark, d).select("q_id", "doc_id").withColumn("hit", F.lit(1)), ["q_id", "doc_id"], "left").fillna(0, ["hit"])
    return metrics.rank_auc(rows, "p", "hit")


@query
def contest_anatomy(spark, d):
    return census.contests(decide.accept(pool(spark, d).select("q_id", "doc_id", "p"), 0.3))


@query
def unclaimed_near_match(spark, d):
    return census.unclaimed(pool(spark, d), links(spark, d).where("p >= 0.6"), 0.4)


@query
def set_change_classes(spark, d):
    return metrics.changes(links(spark, d), decide.drop_contested(decide.accept(pool(spark, d).select("q_id", "doc_id", "p"), 0.5)))


@query
def mirror_census(spark, d):
    return census.offset_census_of_groups(parts(spark, d), "name", "id", "size", "type", 25, SHIFTS)


@query
def dq_validator(spark, d):
    lists = src.link_lists(items(spark, d), links(spark, d))
    as_text = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    return src.problems(items(spark, d).select("q_id"), lists, as_text(pool(spark, d)), as_text(docs(spark, d)))


@query
def result_lists(spark, d):
    return src.link_lists(items(spark, d), links(spark, d))


@query
def stratified_sample(spark, d):
    return census.stratified_sample(src.read_table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"], F.col("doc_id"), 5)


@query
def jaro_winkler_pairs(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(sim.jaro_winkler("name_a", "name_b"), 6).alias("jw"))


@query
def token_set_ratio_pairs(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(sim.set_ratio("name_a", "name_b"), 6).alias("set_ratio"), F.round(sim.sorted_ratio("name_a", "name_b"), 6).alias("sort_ratio"), sim.name_typology("name_a", "name_b").alias("kind"))


@query
def translit_names(spark, d):
    return src.read_table(spark, d, "conversations").select("conv_id", "turn", tx.transliterate("text").alias("latin"), tx.has_indic(F.col("text")).alias("indic"), tx.fold("text").alias("folded"))


@query
def gbt_two_stage(spark, d):
    """Base score out of fold, its competition block, and a second stage out of fold."""
    rows = pool(spark, d).join(truth(spark, d).select("q_id", "doc_id").withColumn("y", F.lit(1.0)), ["q_id", "doc_id"], "left").fillna(0.0, ["y"]).select("q_id", "doc_id", "y", "p", F.col("rank").cast("double").alias("r")).persist()
    base = models.out_of_fold(rows, ["p", "r"], "y", "q_id", "pb")
    block = windows.competition(base.select("q_id", "doc_id", F.col("pb").alias("s")), "q_id", "doc_id", "s").select("q_id", "doc_id", "pct", "to_second", "to_top", "std", "mean")
    both = base.join(block, ["q_id", "doc_id"])
    return models.out_of_fold(both, ["p", "r", "pb", "pct", "to_second", "to_top", "std", "mean"], "y", "q_id", "p2", kind="gbt").select("q_id", "doc_id", "y", "pb", "p2")


@query
def expected_f05_sets(spark, d):
    return decide.expected_f05_sets(pool(spark, d).select("q_id", "p"))


@query
def synthetic_pairs(spark, d):
    return census.synthetic_copies(parts(spark, d).select("id", "name"))
