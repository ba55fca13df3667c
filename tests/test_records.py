"""Operators on records, pairs and scores that have no SQL beside them, and edge cases of those that have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import address as ad
from linkloom.functions import similarity as sim
from linkloom.functions import text as tx
from linkloom.operators import blocks, census, evaluate, features, models, retrieval, stats
from linkloom.plans import record_queries as q
from linkloom.sources import tables as src


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_composed_text_is_normalised(spark):
    df = rows(spark, [("café NULL x_1",), ("café x_1",), (None,)], "t string")
    assert [r.n for r in df.select(tx.normalise(F.col("t")).alias("n")).collect()] == ["café x_1", "café x_1", ""]


def test_edits_are_of_multisets(spark):
    cases = {(("a",), ("a", "a")): "add", (("a", "a", "b"), ("a", "b", "b")): "sub", (("a", "b"), ("b", "a")): "equal", (("a", "a"), ("a",)): "drop", (("a",), ("b", "c")): "other"}
    df = rows(spark, [(list(x), list(y), k) for (x, y), k in cases.items()], "x array<string>, y array<string>, k string")
    assert all(r.k == r.got for r in df.withColumn("got", features.edit_kind(F.col("x"), F.col("y"))).collect())


def test_transliteration():
    assert tx.transliterate_text("राम") == "raam"
    assert tx.transliterate_text("ज़ी") == "jii" and tx.transliterate_text("दुःख") == "duhkh"
    assert tx.transliterate_text("राम", simplify=True) == "ram" and tx.transliterate_text("abc") == "abc"
    assert tx.simplified("bhaasha") == "basa" and tx.skeleton("kabir xavier") == "kpr ksvr"


def test_addresses(spark):
    parts = one(spark, ad.street_parts(F.lit("le parvis, 007 rue de la paix, 75002 paris")))
    assert (parts.number, parts.street, parts.rest) == ("7", ["paix"], ["paris", "parvis"])
    typed = one(spark, ad.street_parts_typed(F.lit("apt 4 rue x, 12 main street, 99 city")))
    assert (typed.number, typed.street) == ("12", ["main"])
    assert tuple(one(spark, ad.house_and_street(F.lit("resid 123456, 12b av des champs 3")))) == (12, "avenue champs")
    assert tuple(one(spark, ad.house_and_street(F.lit(None).cast("string")))) == (-1, "")
    sig = one(spark, ad.street_signatures(F.lit("5 eleventh street, 11th ave, 75001 paris, lyon")))
    assert [(x.numbers, x.key) for x in sig] == [(["5"], "o11"), ([], "o11")]
    assert one(spark, ad.locality(F.lit("1 a st, the springfield, il"))) == "il springfield" and one(spark, ad.locality(F.lit("springfield"))) is None
    assert [one(spark, ad.legal_like(F.lit(t))) for t in ("ltd", "ldt", "lxd", "lt", "limitid", "abc")] == [True, True, True, False, True, False]


def test_relations(spark):
    assert one(spark, ad.number_relation(F.lit("12"), F.array(F.lit("7"), F.lit("12")))) == "exact"
    want = {("12", "123"): "prefix", ("12", "13"): "d<=2", ("12", "72"): "1digit", ("99", "101"): "d<=2", ("95", "110"): "d<=20", ("5", "900"): "far"}
    assert {k: one(spark, ad.number_relation(F.lit(k[0]), F.array(F.lit(k[1])))) for k in want} == want
    kinds = {("12", "21"): "PERM", ("12", "17"): "DIGSUB", ("12", "112"): "DIGINDEL", ("12", "13"): "D1", ("12", "40"): "EVEN", ("12", None): "MISSING"}
    assert {k: one(spark, ad.number_typology(F.lit(k[0]), F.lit(k[1]).cast("string"))) for k in kinds} == kinds
    assert one(spark, ad.name_relation(F.lit("#shop"), F.lit("shop"))) == "url" and one(spark, ad.name_relation(F.lit("a ltd"), F.lit("a"))) == "core_eq"
    assert [evaluate.char_edit(*p) for p in (("form", "from"), ("b0b", "bob"), ("cat", "cut"), ("leter", "letter"), ("cat", "cart"), ("cart", "cat"), ("a", "xyz"))] == ["transpose", "leet", "sub", "double", "insert", "delete", "other"]


def test_cross_source_agreement(spark):
    pool = rows(spark, [(1, 10, 0, "red ring", "1 a st"), (1, 11, 1, "ring red", "1 a st"), (1, 12, 1, "blue", ""), (1, 13, 0, "", ""), (2, 10, 0, "red", "x")], "q_id long, doc_id long, src int, name string, addr string")
    got = {(r.q_id, r.doc_id): (r.same_addr, r.near_name, r.both) for r in blocks.cross_source(pool).collect()}
    assert got == {(1, 10): (1, 1, 1), (1, 11): (1, 1, 1), (1, 12): (0, 0, 0), (1, 13): (0, 0, 0), (2, 10): (0, 0, 0)}


def test_containment_meets_brute_force(spark):
    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(draw.choice(words, n))
    asked = rows(spark, [(k, text(int(draw.integers(1, 9)))) for k in range(25)] + [(99, ""), (98, None)], "q_id long, text string")
    docs = rows(spark, [(k, text(int(draw.integers(0, 25)))) for k in range(60)], "doc_id long, text string")
    tokens = tx.ascii_tokens(F.col("text"))
    for share in (0.6, 1.0, 0.3):
        want = set()
        for x in asked.collect():
            for y in docs.collect():
                a, b = set((x.text or "").split()), set(y.text.split())
                if a and len(a & b) >= share * len(a):
                    want.add((x.q_id, y.doc_id, len(a & b)))
        assert {tuple(r) for r in retrieval.containment(asked, tokens, docs, tokens, share).collect()} == want


def test_census_of_groups_counts_all_pairs(spark):
    from linkloom.operators import census

    draw = np.random.default_rng(5)
    data = [(k, f"g{draw.integers(3)}", int(draw.integers(1, 40)), f"t{draw.integers(2)}") for k in range(120)]
    got = {r.t: (r.n, r.n_shift, r.n_mirror) for r in census.offset_census_of_groups(rows(spark, data, "id long, g string, x int, t string"), "g", "id", "x", "t", 25, [1, 3]).collect()}
    want = {}
    for a, g, x, t in data:
        for b, h, y, _ in data:
            if g == h and a < b and abs(y - x) <= 25:
                n = want.setdefault(t, [0, 0, 0])
                n[0], n[1], n[2] = n[0] + 1, n[1] + (y - x in (1, 3)), n[2] + (x - y in (1, 3))
    assert got == {t: tuple(n) for t, n in want.items()}


def test_auc_over_many_buckets(spark):
    from linkloom.operators import metrics

    draw = np.random.default_rng(6)
    data = [(round(float(p), 3), int(h)) for p, h in zip(draw.random(400), draw.random(400) < 0.4, strict=True)]
    pos, neg = [p for p, h in data if h], [p for p, h in data if not h]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.rank_auc(rows(spark, data, "p double, hit int"), "p", "hit", 16).first().auc == pytest.approx(want, abs=1e-6)


def test_shifted_logits_meet_the_target(spark):
    df = rows(spark, [(0.1,), (0.4,), (0.7,), (0.95,)], "p double")
    shift, moved = evaluate.logit_shift(df, 0.3)
    assert shift < 0 and moved.agg(F.avg("p")).first()[0] == pytest.approx(0.3)


def test_incremental_logit_finds_the_flag(spark):
    draw = np.random.default_rng(7)
    p, flag = draw.random(3000) * 0.8 + 0.1, draw.integers(0, 2, 3000)
    odds = p / (1 - p) * np.exp(1.0 * flag)
    hit = (draw.random(3000) < odds / (1 + odds)).astype(int)
    out = evaluate.incremental_logit(rows(spark, [(float(a), int(b), int(c)) for a, b, c in zip(p, flag, hit, strict=True)], "p double, flag int, hit int"), "flag")
    assert abs(out["coefficient"] - 1.0) < 4 * out["error"] < 0.8 and out["chi2"] > 20


def test_a_histogram_over_its_bound_raises(spark):
    counts = rows(spark, [(3, 5), (9, 1)], "n long, owners long")
    with pytest.raises(ValueError):
        evaluate.binomial_thinning(counts, 0.5, counts, 8)
    got = {r.k: r.expected for r in evaluate.binomial_thinning(counts, 0.5, counts, 9).collect()}
    assert got[0] == pytest.approx(5 / 8 + 1 / 512, abs=1e-6) and sum(got.values()) == pytest.approx(6, abs=1e-5)


def test_whole_orders_by_ranges(spark):
    draw = np.random.default_rng(8)
    data = [(k, float(draw.integers(50))) for k in range(300)]
    got = stats.numbered(rows(spark, data, "id long, x double"), [F.col("x"), F.col("id")], None).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [k for k, x in sorted(data, key=lambda r: (r[1], r[0]))] and sorted(r.place for r in got) == list(range(1, 301))


def test_partitions_are_written_once(spark, tmp_path):
    df = rows(spark, [("a b", 1), ("c", 2), ("c", 3)], "part string, x int")
    assert sorted(tuple(r) for r in src.materialise_by(df, f"{tmp_path}/t", "part", ["a b", "c"]).select("part", "x").collect()) == [("a b", 1), ("c", 2), ("c", 3)]
    again = src.materialise_by(df.withColumn("x", F.lit(9)), f"{tmp_path}/t", "part", ["a b", "c"])
    assert sorted(r.x for r in again.collect()) == [1, 2, 3]


def test_model_audits(spark):
    draw = np.random.default_rng(9)
    data = [(k, f"p{k % 3}", float(x), float(y), float(x + 0.3 * y > 0.6)) for k, (x, y) in enumerate(draw.random((400, 2)))]
    df = rows(spark, data, "q_id long, part string, a double, b double, y double")
    gain = models.feature_gain(models.gradient_boosting(df, ["a", "b"], "y", trees=3), ["a", "b"])
    assert gain["a"] > gain["b"] and math.isclose(sum(gain.values()), 1)
    left = models.leave_one_out(df, ["a", "b"], "y", "part", "p")
    assert left.count() == 400 and left.where("(p > 0.5) = (y = 1)").count() > 360
    curve = models.learning_curve(df, ["a", "b"], "y", "q_id", [0.1, 1.0])
    assert curve[1.0] < curve[0.1] + 0.05 and 0 <= models.seed_stability(df, ["a", "b"], "y", [1, 2]) < 1
    arms = models.run_arms(df, {"a": ["a"], "both": ["a", "b"]}, "y", "q_id", lambda d: d.where("(p_arm > 0.5) = (y = 1)").count() / 400)
    assert arms["both"] >= arms["a"] > 0.7


def test_record_queries_of_empty_tables(spark, sf, tmp_path):
    """Every query over empty tables gives its columns and no error."""
    for name in ("part", "lineitem", "orders", "customer", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("street_parts", "record_relations", "number_block_full", "competing_owner_block", "set_shape", "claimer_by_margin", "candidate_lists", "sorted_by_composite_key", "half_splits"):
        assert q.QUERIES[name](spark, str(tmp_path)).collect() == [], name


def test_street_match(spark):
    data = [
        (1, "12 rue victor hugo, paris", "12 r victor hugo, lyon"), (2, "5 main st, 7 oak av", "9 okk ave, boston"),
        (3, "null", "5 main st"), (4, "3 elm st", "st"), (5, "3 elm st", None),
    ]
    df = rows(spark, data, "k long, aa string, ab string")
    got = {r.k: r for r in blocks.street_match(df, ad.street_signatures(F.col("aa")), ad.street_signatures(F.col("ab"))).collect()}
    assert len(got) == 5 and (got[1].street_exact, got[1].street_fuzzy, got[1].number_agree) == (1.0, 1.0, 1)
    best = max(sim.token_set_ratio(x, y) for x in ("main", "oak") for y in ("okk",))
    assert got[2].street_exact == 0 and got[2].number_agree == 0 and math.isclose(got[2].street_fuzzy, round(best, 6))
    for k in (3, 4, 5):
        assert (got[k].street_exact, got[k].street_fuzzy, got[k].number_agree) == (None, None, -1)


def test_quota_sample(spark):
    data = [(k, "a" if k < 80 else "b" if k < 99 else None) for k in range(100)]
    df = rows(spark, data, "id long, s string")
    got = census.quota_sample(df, ["s"], F.col("id"), 10, 2)
    assert got.columns == ["id", "s"] and {r.s: r.n for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 8, "b": 2, None: 1}
    assert census.quota_sample(df.where("false"), ["s"], F.col("id"), 10, 2).count() == 0


def test_rerank_diagnostic(spark):
    data = [(1, 10, 1, 0, 0.1), (1, 11, 2, 1, 0.9), (2, 10, 1, 1, 0.2), (2, 11, 2, 0, 0.8), (3, 10, 1, 1, 0.9), (3, 11, 2, 0, 0.1), (4, 10, 1, 0, 0.5)]
    df = rows(spark, data, "q_id long, doc_id long, rank int, hit int, s double")
    assert tuple(evaluate.rerank_diagnostic(df, ["q_id"], "s", 1).first()) == (3, 1, 1, 1)
    assert tuple(evaluate.rerank_diagnostic(df.where("false"), ["q_id"], "s", 1).first()) == (0, 0, 0, 0)


def test_address_typologies(spark):
    data = [(["main"], ["main"], "S_SAME"), (["johnson"], ["johnsen"], "S_TYPO"), (["hugo", "victor"], ["victor"], "S_PARTIAL"), (["main"], ["oak"], "S_DIFF"), ([], ["oak"], "S_NA"), (None, ["oak"], "S_NA")]
    df = rows(spark, data, "a array<string>, b array<string>, kind string")
    joined = df.withColumns({f"j{c}": F.array_join(c, " ") for c in "ab"})
    got = joined.select("kind", ad.street_typology(F.col("a"), F.col("b"), sim.sorted_ratio("ja", "jb"), sim.set_ratio("ja", "jb")).alias("got")).collect()
    assert [r.got for r in got] == [r.kind for r in got]
    data = [("apt 4, 3 elm st", "apt 04, 3 elm st", "U_SAME"), ("apt 4", "unit 5", "U_CHANGE"), ("apt 4", "3 elm st", "U_RECDROP"), (None, "suite b", "U_RECADD"), ("", "null", "U_NONE")]
    df = rows(spark, data, "a string, b string, kind string")
    got = df.select("kind", ad.unit_typology(ad.unit_numbers(F.col("a")), ad.unit_numbers(F.col("b"))).alias("got")).collect()
    assert [r.got for r in got] == [r.kind for r in got]


def broadcasts(df):
    """The joins by broadcast that are planned before anything runs, from sizes of files."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastHashJoin")


def test_grouped_topk_is_bm25_topk(spark, sf):
    """Few names for many parts: equal texts are scored once, with repeated ids, missing texts and ties as they were."""
    data = [("p", k, name) for k, name in enumerate(["red ring", "red bolt", "red ring", None, "blue ring", "red ring", "red bolt", "x"])] + [("q", 20, "red ring"), ("q", 21, "old bolt"), ("p", 2, "red ring"), ("p", 5, "blue bolt"), (None, 30, "red ring")]
    docs = rows(spark, data, "part string, doc_id long, text string")
    asked = rows(spark, [(1, "red ring"), (2, "blue bolt"), (3, None)], "q_id long, text string")
    grams = tx.char_grams(F.col("text"))
    plain = retrieval.bm25_index(docs, grams, max_df=5)
    of = lambda df: sorted(tuple(r) for r in df.collect())
    for k in (1, 3, 50):
        assert of(retrieval.grouped_topk(asked, grams, *retrieval.grouped_index(docs, grams, 5), k)) == of(retrieval.bm25_topk(asked, grams, plain, k).select("part", "q_id", "doc_id", "score", "rank"))
    assert broadcasts(q.QUERIES["deep_pool_prefix"](spark, sf)) <= 1  # sizes of parts


def test_grouped_pair_scores_are_pair_scores(spark, sf):
    data = [("p", k, name) for k, name in enumerate(["red ring", "red bolt", "red ring", None, "blue ring", "red ring"])] + [("q", 2, "old bolt"), ("p", 5, "blue bolt"), (None, 9, "red ring")]
    docs = rows(spark, data, "part string, doc_id long, text string")
    asked = rows(spark, [(1, "red ring"), (2, "blue bolt"), (3, None)], "q_id long, text string")
    grams = tx.char_grams(F.col("text"))
    pairs = asked.select("q_id").crossJoin(docs.select("doc_id").distinct())
    plain = retrieval.pair_scores(pairs.join(docs.select("part", "doc_id").distinct(), "doc_id"), asked, grams, retrieval.bm25_index(docs, grams, max_df=5))
    of = lambda df: sorted(str(tuple(r)) for r in df.select("part", "q_id", "doc_id", "score").collect())
    assert of(retrieval.grouped_pair_scores(pairs, asked, grams, *retrieval.grouped_index(docs, grams, 5))) == of(plain)
    assert broadcasts(q.QUERIES["exact_pair_scores"](spark, sf)) <= 1  # sizes of parts


def test_rerank_diagnostic_broadcasts_no_records(spark, sf):
    assert broadcasts(q.QUERIES["rerank_diagnostic"](spark, sf)) <= 1  # sizes of parts


def test_containing_counts_equal_records_once_and_repeated_ids_once(spark, sf):
    data = [(1, ["a", "b"], "p", "7"), (2, ["a", "b"], "p", "7"), (3, ["a"], "p", None), (4, ["a", "b", "c"], "p", "8"), (4, ["a", "b"], "p", "7"), (5, ["a", "b"], "q", "7"), (6, [], "p", "7"), (1, ["a", "b"], "p", "7"), (7, ["b"], None, "7")]
    df = rows(spark, data, "id long, ts array<string>, part string, number string")
    asked = rows(spark, [(k, *r[1:]) for k, r in enumerate(data)], "q long, ts array<string>, part string, number string")
    want = {k: len({i for i, ts, part, number in data if part == r[2] and set(r[1]) <= set(ts) and r[3] in (None, number)}) for k, r in enumerate(data) if r[1] and r[2]}
    assert {r.q: r.n for r in blocks.containing(df, asked, "part", "number").collect()} == want
    assert broadcasts(q.QUERIES["competing_owner_block"](spark, sf)) <= 1  # lines of orders, where their file is small
