"""Secret scans: pattern spans, and further spans by how many owners hold a candidate across the corpus.

All work is done by DataFrame functions. The patterns give the base spans. Other opaque strings are only candidates. The values
of both are hashed and aggregated by owner and by repository (a text; exact copies of one are one repository): a value that
more than max_owners owners hold is a copied example, any other is owner-specific and looks live. Base spans stay whatever
their class is; candidates are added where they look live. A value in a third of all rows is a few rows after the first step
of the aggregate. Positions and overlaps cost about the matches of a text to the power of 1.5 at most, or sort them.

Defined results: a null text counts as empty: no span, and the hash of the empty string; so does an empty table. Very long texts
are scanned whole. A null owner is an owner of its own. Repeated rows get equal results. Spans that the patterns overlap are
each reported, in the order of start, then kind; a candidate that overlaps a base span isn't. Other columns pass as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import materialise

# The patterns of the contract. Group 1 of the first is its value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run holds no longer one: the same matches as dropping those under 16
HEX = r"[0-9a-f]{32,}"  # whole runs, so the same matches as dropping those under 32
KINDS = ("assign", "access", "hex", "owned")
CLASSES = ("owned", "copied")

# Runs with a letter and a digit; each part looks at a run from its start only.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}"
SPAN = "struct<start:int,kind:int,end:int,hash:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array of integers: op over each value and all before it, from 0. Stretches of about the root of the length are
    summed up first, so that no value looks back over more than one stretch."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: op(a, b))

    def stretches(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["x"]) / s["c"]).cast("int")), lambda j: total(F.slice(s["x"], j * s["c"] + 1, s["c"])))
        return _let(sums, lambda y: F.transform(y, lambda _, j: total(F.slice(y, F.lit(1), j))))

    def ends(s: Column) -> Column:
        first = lambda i: F.floor(i / s["c"]).cast("int")
        return _let(stretches(s), lambda y: F.transform(s["x"], lambda _, i: op(F.get(y, first(i)), total(F.slice(s["x"], first(i) * s["c"] + 1, i - first(i) * s["c"] + 1)))))

    return _let(F.struct(values.alias("x"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int").alias("c")), ends)


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Matches of the pattern in order, as SPAN: code points, end exclusive, and the hash of the group's value."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.split(text, pattern, -1).alias("between"))

    def spans(p: Column) -> Column:
        steps = F.transform(p["whole"], lambda w, i: F.length(F.get(p["between"], i)) + F.length(w))

        def span(e: Column) -> Column:
            one = lambda w, i: F.struct((F.get(e, i) - F.length(w)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(e, i).alias("end"), F.xxhash64(F.get(p["value"], i)).alias("hash"), F.get(p["value"], i).alias("v"))
            fine = lambda x: (F.length(x["v"]) >= least) & (_opaque(x["v"]) if kind == "owned" else F.lit(True))
            return F.transform(F.filter(F.transform(p["whole"], one), fine), lambda x: F.struct(x["start"], x["kind"], x["end"], x["hash"]))

        return _let(_running(steps, lambda a, b: a + b), span)

    return F.when(text.rlike(pattern), _let(parts, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _opaque(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= 8


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(values: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories. Rows: hash, owner, text_hash; each pair is made distinct before the shuffle."""
    owner = F.xxhash64("owner", F.col("owner").isNull())
    return values.groupBy("hash").agg(F.count_distinct(owner).alias("n_owners"), F.count_distinct("text_hash").alias("n_repositories"))


def _uncovered(spans: DataFrame) -> DataFrame:
    """Base spans, and candidates that overlap none of their text."""
    at = Window.partitionBy("doc_id", "text_hash").orderBy("start", "kind")
    base = F.col("kind") < KINDS.index("owned")
    before = F.max(F.when(base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(at.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.withColumns({"before": before, "after": after})
    return marked.where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))).drop("before", "after")


def scan(docs: DataFrame, owner: str = "source", max_owners: int = 2) -> DataFrame:
    """doc_id, text_hash and spans (array of start, kind, end, hash, n_owners, n_repositories, copied) of every row."""
    text = F.coalesce("text", F.lit(""))
    every = F.concat(_found(text, ASSIGN, "assign", 1, 8), _found(text, ACCESS, "access"), _found(text, HEX, "hex"), _found(text, CANDIDATE, "owned"))
    hits = materialise(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col(owner).alias("owner"), every.alias("found")), "secret-hits")
    held = hits.where(F.size("found") > 0)
    values = held.select("doc_id", "text_hash", "owner", F.explode("found").alias("x")).select("doc_id", "text_hash", "owner", "x.*")
    owners = ownership(values).withColumn("copied", F.col("n_owners") > max_owners)
    spans = _uncovered(values.drop("owner").distinct()).join(owners, "hash").where((F.col("kind") < KINDS.index("owned")) | ~F.col("copied"))
    judged = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repositories", "copied"))).alias("spans"))
    judged = judged.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "spans")
    none = F.array().cast(judged.schema["spans"].dataType)
    joined = held.join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))
    return joined.union(hits.where(F.size("found") == 0).select("doc_id", "text_hash", none.alias("spans")))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans, and the class of each (owned or copied)."""
    rows = scan(docs, **options).withColumn("base", F.filter("spans", lambda x: x["kind"] < KINDS.index("owned")))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    classes = F.array_join(F.transform("spans", lambda x: F.when(x["copied"], F.lit(CLASSES[1])).otherwise(F.lit(CLASSES[0]))), ",")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), classes.alias("classes"))


def mask(docs: DataFrame, mark: str = "<secret>", **options) -> DataFrame:
    """The pipeline's stage: every span of a row's text is replaced by the mark, and n_chars follows; rows and columns stay."""
    suspect = F.coalesce(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{CANDIDATE}"), F.lit(False))
    some = docs.where(suspect)
    spans = scan(some, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "spans").dropDuplicates(["d", "t"])
    # Rows travel as one struct, so that no column of theirs can clash with another name here.
    rows = some.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"))
    joined = rows.join(spans, F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left")
    text = F.col("row")["text"]

    def masked(s: Column) -> Column:
        def parts(ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
            part = lambda x, i: F.when(x["start"] < before(i), F.lit("")).otherwise(F.concat(F.substr(text, before(i) + 1, x["start"] - before(i)), F.lit(mark)))
            return F.concat(F.array_join(F.transform(s, part), ""), F.substr(text, F.element_at(ends, -1) + 1))

        return _let(_running(F.transform(s, lambda x: x["end"]), F.greatest), parts)

    new = joined.withColumn("new", F.when(F.col("spans").isNotNull(), _let(F.col("spans"), masked)).otherwise(text))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return new.select(*[x.alias(c) for c, x in columns.items()]).union(docs.where(~suspect))
