"""Lexical and dense retrieval: every operator returns long rows (query, document, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.stats import idf


def ranked(scores: DataFrame, by: tuple[str, ...], score: str, tie: str, k: int | None = None, name: str = "rank") -> DataFrame:
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))))
    return out if k is None else out.where(F.col(name) <= k)


def bm25_index(docs: DataFrame, tokens: Column, max_df_share: float | None = None, max_df: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Postings (part, token, doc_id, weight) of docs (part, doc_id) with binary term frequency.

    Frequent tokens go from the postings, which bounds the longest posting list, but count in the document lengths.
    """
    rows = docs.select("part", "doc_id", F.array_distinct(tokens).alias("ts"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    postings = rows.select("part", "doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    df = postings.groupBy("part", "token").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "part")  # sizes: a row a part
    if max_df_share is not None:
        df = df.where(F.col("df") <= max_df_share * F.col("n"))
    if max_df is not None:
        df = df.where(F.col("df") <= max_df)
    weight = idf(F.col("n"), F.col("df")) * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(df, ["part", "token"]).select("part", "token", "doc_id", weight.alias("weight"))


def bm25_scores(queries: DataFrame, tokens: Column, index: DataFrame) -> DataFrame:
    """Score of every (part, q_id, doc_id) that shares a kept token; rounded, so that ties are ties on any machine."""
    asked = queries.select("q_id", F.explode(F.array_distinct(tokens)).alias("token"))
    return asked.join(index, "token").groupBy("part", "q_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))


def bm25_topk(queries: DataFrame, q_tokens: Column, index: DataFrame, k: int) -> DataFrame:
    return ranked(bm25_scores(queries, q_tokens, index), ("part", "q_id"), "score", "doc_id", k)


def reverse_topk(queries: DataFrame, q_tokens: Column, index: DataFrame, k: int) -> DataFrame:
    """The best queries of each document: the same scores, ranked the other way round."""
    return ranked(bm25_scores(queries, q_tokens, index), ("part", "doc_id"), "score", "q_id", k)


def grouped_index(docs: DataFrame, tokens: Column, max_df: int, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """bm25_index() of docs (part, doc_id, text) over classes of documents with equal texts, which have equal scores.

    Returns the members (part, rep, doc_id) of each class, rep being its smallest id, and the postings (part, token, rep, weight).
    tokens: of the column text. Rows that repeat an id are one document, whose weights add up as they do in bm25_scores().
    Every join is by sorting: sizes of files say little of rows that a dictionary had folded, and a broadcast fills the driver.
    """
    whole = docs.groupBy("part", "doc_id").agg(F.array_sort(F.collect_list(F.struct("text"))).alias("texts"))
    classes = whole.groupBy("part", "texts").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held"))
    same = F.col("w.part").eqNullSafe(F.col("c.part")) & (F.col("w.texts") == F.col("c.texts"))
    members = whole.alias("w").join(classes.alias("c").hint("merge"), same).select("w.part", "rep", "doc_id")
    rows = classes.select("part", "rep", "held", F.explode("texts.text").alias("text")).select("part", "rep", "held", F.array_distinct(tokens).alias("ts"))
    sizes = rows.groupBy("part").agg(F.sum("held").alias("n"), (F.sum(F.col("held") * F.size("ts")) / F.sum("held")).alias("avgdl"))
    postings = rows.select("part", "rep", "held", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    df = postings.groupBy("part", "token").agg(F.sum("held").alias("df")).where(F.col("df") <= max_df).join(F.broadcast(sizes), "part")  # sizes: a row a part
    weight = idf(F.col("n"), F.col("df")) * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return members, postings.join(df.hint("merge"), ["part", "token"]).select("part", "token", "rep", weight.alias("weight"))


def grouped_topk(queries: DataFrame, q_tokens: Column, members: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """bm25_topk() over a grouped_index().

    The best k documents are among the first k of the best k classes, by score and smallest id: each class before one has a
    document, that id, which comes before all of the other's.
    """
    asked = queries.select("q_id", F.explode(F.array_distinct(q_tokens)).alias("token"))
    scores = asked.join(postings.hint("merge"), "token").groupBy("part", "q_id", "rep").agg(F.round(F.sum("weight"), 6).alias("score"))
    best = ranked(scores, ("part", "q_id"), "score", "rep", k, "_class").drop("_class")
    order = Window.partitionBy("part", "rep").orderBy("doc_id")
    first = members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return ranked(best.join(first.hint("merge"), ["part", "rep"]), ("part", "q_id"), "score", "doc_id", k).select("part", "q_id", "doc_id", "score", "rank")


def grouped_pair_scores(pairs: DataFrame, queries: DataFrame, q_tokens: Column, members: DataFrame, postings: DataFrame) -> DataFrame:
    """pair_scores() over a grouped_index() of distinct pairs (q_id, doc_id), in each part that the document is in. A score is
    worked out once for each query and class that a pair names."""
    asked = queries.select("q_id", F.explode(F.array_distinct(q_tokens)).alias("token"))
    named = pairs.select("q_id", "doc_id").join(members.hint("merge"), "doc_id")
    found = named.select("part", "q_id", "rep").distinct().join(asked.hint("merge"), "q_id").join(postings.hint("merge"), ["part", "rep", "token"])
    scores = found.groupBy("part", "q_id", "rep").agg(F.round(F.sum("weight"), 6).alias("score"))
    return named.join(scores.hint("merge"), ["part", "q_id", "rep"], "left").fillna(0.0, ["score"]).select("part", "q_id", "doc_id", "score")


def pool_union(a: DataFrame, b: DataFrame, absent: int = 999) -> DataFrame:
    """Full outer union of two ranked lists over (q_id, doc_id), absent ranks filled at the end."""
    left = a.select("q_id", "doc_id", F.col("rank").alias("rank_a"))
    right = b.select("q_id", "doc_id", F.col("rank").alias("rank_b"))
    return left.join(right, ["q_id", "doc_id"], "full").fillna(absent, ["rank_a", "rank_b"])


def capped_union(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """a's candidates in their order, then b's others, at most k a query."""
    both = a.select("q_id", "doc_id", F.lit(0).alias("side"), "rank").union(b.select("q_id", "doc_id", F.lit(1).alias("side"), "rank"))
    first = both.groupBy("q_id", "doc_id").agg(F.min(F.struct("side", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("at", "doc_id"))
    return first.withColumn("place", place).where(F.col("place") <= k).select("q_id", "doc_id", "place")


def containment(queries: DataFrame, q_tokens: Column, docs: DataFrame, d_tokens: Column, share: float = 1.0) -> DataFrame:
    """(q_id, doc_id, shared) where the document holds at least that share of the query's distinct tokens.

    A document that holds so many of them holds one of the query's size - least + 1 rarest tokens. Candidates meet by these
    alone, so frequent words join nothing; then token arrays are compared. Documents meet the few tokens that queries ask by.
    """
    rows = docs.select("doc_id", F.array_distinct(d_tokens).alias("ts"))
    asked = queries.select("q_id", F.array_distinct(q_tokens).alias("qs")).where(F.size("qs") > 0)
    long = asked.select("q_id", F.size("qs").alias("size"), F.explode("qs").alias("token"))
    held = rows.select("doc_id", F.explode("ts").alias("token")).join(long.select("token").distinct(), "token", "left_semi")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("q_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    least = F.ceil(F.round(F.lit(share) * F.col("size"), 9))
    keys = long.join(df, "token", "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("size") - least + 1).select("q_id", "token")
    pairs = keys.join(held, "token").select("q_id", "doc_id").distinct()
    both = pairs.join(asked, "q_id").join(rows, "doc_id").select("q_id", "doc_id", F.size("qs").alias("size"), F.size(F.array_intersect("qs", "ts")).cast("long").alias("shared"))
    return both.where(F.col("shared") >= share * F.col("size")).select("q_id", "doc_id", "shared")


def deletion_siblings(names: DataFrame, keys: Column) -> DataFrame:
    """Pairs (a, b, key) of names that become equal when each gives up one token. Rows: id."""
    exploded = names.select("id", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")
    return exploded.select(F.col("id").alias("a"), "key").join(exploded.select(F.col("id").alias("b"), "key"), "key").where("a < b").groupBy("a", "b").agg(F.min("key").alias("key"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, max_queries: int = 200_000) -> DataFrame:
    """Exact inner-product top k of queries (q_id, vec) among vectors (doc_id, vec).

    The queries are a stated set of at most max_queries (more raise: split them): they go to every task in blocks that numpy
    multiplies, and each batch of vectors yields k rows a query before anything is shuffled.
    """
    import numpy as np
    import pandas as pd

    if queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: ask in parts")
    rows = queries.select("q_id", "vec").collect()
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

    def best(batches):
        ids, asked = shared.value
        for pdf in batches:
            docs, table = pdf["doc_id"].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            for at in range(0, len(ids), 256):
                score = np.round(asked[at : at + 256] @ table.T, 6)
                for q, s in zip(ids[at : at + 256], score, strict=True):
                    top = np.lexsort((docs, -s))[:k]
                    yield pd.DataFrame({"q_id": q, "doc_id": docs[top], "score": s[top]})

    return ranked(vectors.select("doc_id", "vec").mapInPandas(best, "q_id long, doc_id long, score double"), ("q_id",), "score", "doc_id", k)


def gold_ranks(queries: DataFrame, vectors: DataFrame, gold: DataFrame) -> DataFrame:
    """(q_id, doc_id, score, rank) of given pairs gold: one more than the vectors with a strictly greater inner product.

    The gold scores are a table of the queries' size; every batch of vectors counts what exceeds them, and counts are summed.
    """
    import numpy as np
    import pandas as pd

    dot = lambda x, y: F.round(F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda a, p: a + p), 6)
    known = gold.join(queries, "q_id").join(vectors.withColumnRenamed("vec", "other"), "doc_id").select("q_id", "doc_id", "vec", dot("vec", "other").alias("score"))
    rows = known.collect()
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r["vec"] for r in rows], np.float64), np.array([r["score"] for r in rows])))

    def above(batches):
        asked, scores = shared.value
        n = np.zeros(len(scores), np.int64)
        for pdf in batches:
            table = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            for at in range(0, len(scores), 256):
                n[at : at + 256] += (np.round(asked[at : at + 256] @ table.T, 6) > scores[at : at + 256, None]).sum(1)
        yield pd.DataFrame({"at": np.arange(len(n)), "n": n})

    counts = vectors.select("vec").mapInPandas(above, "at long, n long").groupBy("at").agg((F.sum("n") + 1).alias("rank"))
    numbered = queries.sparkSession.createDataFrame([(k, r["q_id"], r["doc_id"], float(r["score"])) for k, r in enumerate(rows)], "at long, q_id long, doc_id long, score double")
    return numbered.join(counts, "at").drop("at")


def pair_scores(pairs: DataFrame, queries: DataFrame, tokens: Column, index: DataFrame) -> DataFrame:
    """Exact BM25 score of given pairs (part, q_id, doc_id); 0 where no token is shared."""
    asked = queries.select("q_id", F.explode(F.array_distinct(tokens)).alias("token"))
    hits = pairs.join(asked, "q_id").join(index, ["part", "doc_id", "token"]).groupBy("part", "q_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return pairs.join(hits, ["part", "q_id", "doc_id"], "left").fillna(0.0, ["score"])


def keyed_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of rows (id and keys) that agree in all keys, none of them null; the ids differ."""
    left, right = a.select(F.col("id").alias("a"), *keys).dropna(subset=keys), b.select(F.col("id").alias("b"), *keys).dropna(subset=keys)
    return left.join(right, keys).where("a <> b").select("a", "b").distinct()


def unique_at(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id) of the keys, none of them null, that exactly one record has."""
    return records.dropna(subset=keys).groupBy(*keys).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")


def fuzzy_in_group(names: DataFrame, group: str, most: int, max_group: int) -> DataFrame:
    """(group, a, b, d) of names (group, name, id) of one group within most edits. Names of lengths that differ by more never meet;
    a group of more than max_group names raises."""
    if names.groupBy(group).count().where(F.col("count") > max_group).limit(1).count():
        raise ValueError(f"a group holds more than {max_group} names: add a key")
    left = names.select(group, F.col("id").alias("a"), F.col("name").alias("x"), F.explode(F.sequence(F.length("name") - most, F.length("name") + most)).alias("len"))
    right = names.select(group, F.col("id").alias("b"), F.col("name").alias("y"), F.length("name").alias("len"))
    return left.join(right, [group, "len"]).where("a < b").withColumn("d", F.levenshtein("x", "y")).where(F.col("d") <= most).select(group, "a", "b", "d")
