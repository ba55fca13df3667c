import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = (
    "node", "held_out", "score", "lang_pred", "share", "good", "t", "n", "label", "rep", "kept", "n_words", "anomaly", "component_id", "keys", "sig", "spans", "_spans", "base", "owner", "hash",
    "text_hash", "_d", "_t", "_h", "d", "uid", "piece", "shard", "sequence_id", "block", "media", "declared_type", "html", "url", "host", "page_id", "digest", "refers_to",
)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank and very long texts, repeated rows, and columns whose names clash with ours."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "the cat " * 3000, "en", None, 24000),
        (5, "le chat est sur la table", "fr", "b", 24), (5, "le chat est sur la table", "fr", "b", 24), (None, "the dog is here", "en", "b", 15),
        (7, "x" * 50000, None, "c", 50000), (8, "12345 !!", "en", "c", 8),
    ]
    return spark.createDataFrame([(*r, *["mine"] * len(CLASHING)) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
