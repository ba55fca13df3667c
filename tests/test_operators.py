import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions import text as tx
from linkloom.operators import census, decide, metrics, models, retrieval, windows
from linkloom.sources import tables as src

NAMES = st.text("ab c", max_size=12)


@given(NAMES, NAMES)
@settings(max_examples=150, deadline=None)
def test_similarities_are_symmetric_and_bounded(a, b):
    for f in (sim.jaro, sim.winkler, sim.indel_ratio, sim.token_sort_ratio, sim.token_set_ratio):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 1
    assert sim.jaro(a, a) == 1 and sim.indel_ratio(a, a) == 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(NAMES, NAMES)
@settings(max_examples=150, deadline=None)
def test_indel_ratio_is_by_longest_common_subsequence(a, b):
    assert sim.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1)


def test_known_similarities():
    assert sim.winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert sim.token_set_ratio("new york mets", "mets new york") == 1 and sim.token_set_ratio("", "") == 0
    assert [sim.typology("a b", x) for x in ("b a", "ab", "a", "a b c")] == ["SAME", "JOIN", "DROP", "ADD"]
    assert sim.soft_unmatched_count(["alpha", "q"], ["alpha", "beta"]) == 1


def test_transliteration_and_digits(spark):
    assert tx.transliterate_text("राम") == "raam" and tx.transliterate_text("x 1") == "x 1" and tx.transliterate_text(None) is None
    row = spark.createDataFrame([("राम १२", "unit 12, 007 Main", "null Büro-X  null")], "a string, b string, c string").select(
        tx.ascii_digits(F.col("a")).alias("d"), tx.has_indic(F.col("a")).alias("i"), tx.house_number(tx.parsed_numbers(F.col("b"))).alias("h"), tx.numbers(F.col("b")).alias("n"),
        tx.normalise(F.col("c")).alias("norm"), tx.longest(tx.numbers(F.col("b"))).alias("l"), tx.fold("c").alias("f"), tx.consonant_key(F.lit("Khadder")).alias("k"),
    ).first()
    assert (row.d, row.i, row.h, row.n, row.norm, row.l) == ("राम 12", True, "7", ["12", "7"], "büro x", "12")
    assert row.f == "null buro-x  null" and row.k == "kdr"


def test_normalise_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t in ("A--b_c null", "", None, "é É  null NULL", "a.b,c")], "t string").select(tx.normalise(F.col("t")).alias("n"))
    assert all(a == b for a, b in df.select("n", tx.normalise(F.col("n")).alias("m")).collect())


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.9), (2, 11, 0.5), (3, 12, 0.4), (1, 12, 0.8)], "q_id long, doc_id long, p double")


def test_max_claimer_gives_ties_to_the_smaller_owner(links):
    assert sorted(map(tuple, decide.max_claimer(links).collect())) == [(1, 10, 0.9), (1, 12, 0.8), (2, 11, 0.5)]
    assert [r.doc_id for r in decide.drop_contested(links).collect()] == [11]
    assert {r.doc_id for r in decide.with_margin(links, 0.1).collect()} == {11, 12}


def test_veto_never_empties_an_owner(links):
    assert {(r.q_id, r.doc_id) for r in decide.veto(links, links).collect()} == {(r.q_id, r.doc_id) for r in links.collect()}
    assert {(r.q_id, r.doc_id) for r in decide.veto(links, links.where("doc_id = 10")).collect()} == {(1, 12), (2, 11), (3, 12)}


def test_f05_worked_example(spark):
    rows = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 1, 0), (1, 0, 0)], "gt int, pred int, tp int").select(F.round(metrics.f05(), 3).alias("f"))
    assert [r.f for r in rows.collect()] == [0.714, 1.0, 0.0, 0.0]


def test_expected_f05():
    assert decide.expected_f05_size([]) == (0, 1.0)
    assert decide.expected_f05_size([1.0, 1.0, 0.0])[0] == 2
    assert decide.expected_f05_size([0.01])[0] == 0


def test_bm25_against_plain_python(spark):
    import math

    texts = {1: "red small ring", 2: "red ring", 3: "blue widget thing", 4: "", 5: "ring"}
    docs = spark.createDataFrame([("x", k, v) for k, v in texts.items()], "part string, doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(spark.createDataFrame([(7, "red ring")], "q_id long, t string"), tx.ascii_tokens(F.col("t")), retrieval.bm25_index(docs, tx.ascii_tokens(F.col("text")))).collect()}
    sets = {k: set(v.split()) for k, v in texts.items()}
    avg = sum(map(len, sets.values())) / len(sets)
    want = {}
    for k, s in sets.items():
        hit = s & {"red", "ring"}
        if hit:
            df = {t: sum(t in x for x in sets.values()) for t in hit}
            want[k] = sum(math.log((5 - df[t] + 0.5) / (df[t] + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(s) / avg)) for t in hit)
    assert got == pytest.approx(want, abs=1e-6)


def test_competition_of_a_single_row(spark):
    row = windows.competition(spark.createDataFrame([(1, 1, 0.9)], "q_id long, doc_id long, p double"), "q_id", "doc_id", "p").first()
    assert (row.pos, row.second, row.pct, row.n80, row.n90, row["std"]) == (1, 0.0, 1.0, 1, 0, 0.0)


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", "A", "", "US"), ("S1-2", "B", "x", "India")], src.RECORD_SCHEMA)
    src.write_tsv(rows, str(tmp_path / "r"), compression="gzip")
    assert sorted(map(tuple, src.read_tsv(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, rows.collect()))
    assert [r.entity_id for r in src.read_tsv(spark, str(tmp_path / "r"), country="India").collect()] == ["S1-2"]
    (tmp_path / "t.tsv").write_text("k\tm\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    assert sorted(map(str, src.read_truth(spark, str(tmp_path / "t.tsv")).collect())) == sorted(["Row(q_id='S1-1', doc_id='S2-1')", "Row(q_id='S1-1', doc_id='S3-2')", "Row(q_id='S1-2', doc_id=None)"])


def test_result_lists_and_problems(spark, links):
    owners = spark.createDataFrame([(1,), (2,), (9,)], "q_id long")
    lists = {r.q_id: r.matched for r in src.link_lists(owners, links).collect()}
    assert lists == {1: "10,12", 2: "10,11", 9: ""}
    bad = {r.rule: r.n for r in src.problems(owners, src.link_lists(owners, links), links.withColumn("doc_id", F.col("doc_id").cast("string")), spark.createDataFrame([("10",), ("11",)], "doc_id string")).collect()}
    assert bad["record with two owners"] == 1 and bad["unknown record"] == 1 and bad["duplicate owner"] == 0


def test_streams(spark, tmp_path, sf):
    from linkloom.streaming import incremental

    src.read_table(spark, sf, "events").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema(src.read_table(spark, sf, "events").schema).parquet(str(tmp_path / "e"))
    query = incremental.windowed_counts(events, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) AS n FROM w").first().n == src.read_table(spark, sf, "events").count()


def test_synthetic_copies_and_isotonic(spark):
    names = spark.createDataFrame([(k, "alpha beta gamma") for k in range(8)], "id long, name string")
    assert census.synthetic_copies(names, 3).count() == 24
    scored = spark.createDataFrame([(k / 10, float(k > 4)) for k in range(10)], "s double, y double")
    assert [r.c for r in models.isotonic(scored, "s", "y", "c").orderBy("s").collect()] == sorted(float(k > 4) for k in range(10))


def test_blend_rounds_halves_as_sql(spark):
    """0.7 * p + 0.3 * q of six places each often ends in a 5 at the seventh."""
    import duckdb

    values = [(0.285914, 0.341089), (0.315721, 0.941956), (0.110369, 0.176814), (0.637519, 0.928404)]
    df = spark.createDataFrame([(k, k, *v) for k, v in enumerate(values)], "q_id long, doc_id long, p double, o double")
    got = {r.q_id: r.p for r in decide.blend(df.select("q_id", "doc_id", "p"), df.select("q_id", "doc_id", F.col("o").alias("p")), 0.7).collect()}
    want = [duckdb.execute("SELECT round(0.7 * ?::DOUBLE + (1 - 0.7::DOUBLE) * ?::DOUBLE, 6)", v).fetchone()[0] for v in values]
    assert [got[k] for k in range(len(values))] == want
