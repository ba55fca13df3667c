"""Near-duplicate documents by MinHash: bands find candidates, signatures thin them out, full shingle sets confirm them.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence is the one shingle). Documents with
equal sets are one node. The work then runs over nodes:

1. Universal hash minima over each set, cut into bands; two sets of similarity s share a band with probability
   1 - (1 - s^rows)^bands, which leaves out 2 of a million links at s = 0.75 and fewer above.
2. In every large group of nodes with a band key, one centre is compared with all others: one row per member, however large
   the group is. Pairs whose sizes or signatures rule out the similarity go; the others are held against each other on full
   sets. Confirmed links give components (in the driver while they are few, else alternating large-star and small-star). As each
   key has a centre of its own, one round joins nearly all that belongs together.
3. What is left are pairs of one group in different components. All of them are tested: in small groups by a join, in
   large groups block against block. No candidate pair of different components is left out.

Defined results: null, empty and white-space texts have an empty set, link with nothing and are components of their own. Very
long texts are hashed whole; an empty table gives an empty result. Which row of a component has the least doc_id decides, so
ties can't arise but between rows of one doc_id. Columns of docs but doc_id and text are not looked at, whatever their names.
Rows that share a doc_id belong to one component, whatever their texts are, and each keeps its own row. A row without a
doc_id links like any other but is never the one that others are dropped for, and is itself kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import bitmap_of, hits, in_bitmap, map_batches, materialise
from linkloom.llm.components import components


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words_in: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles. bytes.lower and bytes.split take ASCII letters and white space only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(words_in, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class MinHasher:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, bands * rows, np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 128):
            np.minimum(least, (x[at : at + 128, None] * self.a + self.b).min(0), out=least)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.arange(self.bands, dtype=np.uint64) + np.uint64(1)
            for column in minima.reshape(self.bands, self.rows).T.astype(np.uint64):
                h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        return h.astype(np.int64)


def signatures(docs: DataFrame, words_in: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), keys (one a band) and sig (the low byte of each minimum)."""

    def make():
        hashes, hasher = WordHashes(), MinHasher(bands, rows)

        def call(batch: dict) -> dict:
            out = {k: [] for k in ("doc_id", "n_shingles", "node", "keys", "sig")}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, words_in, hashes)
                row = (doc_id, len(s), None, None, None)
                if len(s):
                    least = hasher.minima(s)
                    row = (doc_id, len(s), node_of(s), hasher.band_keys(least), least.astype(np.uint8).tobytes())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return call

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, node long, keys array<long>, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words_in: int, filter_bits: int) -> DataFrame:
    """(node, keys, sig, items) with the sorted shingle hashes of the wanted nodes; wanted: node, rep, keys, sig. A bitmap of the
    reps spares the other documents, and what it lets through in vain the join takes out."""
    bitmap = bitmap_of(wanted, filter_bits)

    def make():
        hashes, words = WordHashes(), bitmap.value

        def call(batch: dict) -> dict:
            held = hits(np.array([0 if d is None else d for d in batch["doc_id"]], np.int64), words, filter_bits)
            found = [s for text, h in zip(batch["text"], held, strict=True) if h and len(s := shingle_set(text, words_in, hashes))]
            return {"node": [node_of(s) for s in found], "items": [s.tobytes() for s in found]}

        return call

    found = map_batches(docs.select("doc_id", "text"), make, "node long, items binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return found.join(wanted.drop("rep"), "node").select("node", "keys", "sig", "items")


class Joined(dict):
    """Nodes that links have joined, to one of them for all."""

    def top(self, x: int) -> int:
        while x in self:
            x = self[x]
        return x


def agreeing(pairs: DataFrame, least_share: float) -> DataFrame:
    """a, b, items_b of the pairs with sig_a and sig_b whose signatures agree in at least that share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((x == y).mean(1) >= least_share)).select(["a", "b", "items_b"]) if batch.num_rows else batch.select(["a", "b", "items_b"])

    return pairs.select("a", "b", "sig_a", "sig_b", "items_b").mapInArrow(run, "a long, b long, items_b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, min_agreement: float) -> DataFrame:
    """Links (u, v) of the pairs (a, b) whose signatures agree and whose full sets reach the similarity; none between nodes that
    the links of the same task join already."""
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = agreeing(pairs.join(sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("items").alias("items_b")), "b"), min_agreement)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")

    def make():
        joined = Joined()

        def call(batch: dict) -> dict:
            out = {"u": [], "v": []}
            for a, b, x, y in zip(batch["a"], batch["b"], batch["items_a"], batch["items_b"], strict=True):
                p, q = joined.top(a), joined.top(b)
                if p == q:
                    continue
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * same >= percent * (len(left) + len(right) - same):
                    joined[p] = q
                    out["u"].append(a)
                    out["v"].append(b)
            return out

        return call

    return map_batches(both.select("a", "b", "items_a", "items_b"), make, "u long, v long")


def links_in_blocks(members: DataFrame, percent: int, min_agreement: float, block: int = 512, block_shingles: int = 1 << 21) -> DataFrame:
    """Links (u, v) between members of a large key group that have different labels; of each two labels in a task only one.

    members: k, node, n, label, main (has the most frequent label of the group), n_main, n_rest, w_main, w_rest (their shingles),
    keys, sig, items. A group is dealt into blocks of main and of other rows, and each two blocks that aren't both main are a
    task's group of about 2 x block rows and 2 x block_shingles at most; a longer text fills a block by itself. A pair of nodes
    is tested in the first band that they share only.
    """
    blocks = lambda part: F.greatest(F.lit(1), F.ceil(F.col(f"n_{part}") / block), F.ceil(F.col(f"w_{part}") / block_shingles)).cast("int")
    h = F.xxhash64("node", "k")
    own = F.when(F.col("main"), blocks("rest") + F.pmod(h, blocks("main"))).otherwise(F.pmod(h, blocks("rest"))).cast("int")
    last = F.when(F.col("main"), blocks("rest") - 1).otherwise(blocks("rest") + blocks("main") - 1)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "label", "keys", "sig", "items")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "node"])
        k, within = pdf["k"].iloc[0], pdf["i"].iloc[0] == pdf["j"].iloc[0]
        own, node, n, label = (pdf[c].to_numpy() for c in ("own", "node", "n", "label"))
        sig, keys = np.stack([np.frombuffer(x, np.uint8) for x in pdf["sig"]]), np.stack(pdf["keys"].to_list())
        items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        joined = Joined()
        u, v = [], []
        for x in range(len(pdf)):
            rest = np.arange(x + 1 if within else max(x + 1, np.searchsorted(own, own[x], "right")), len(pdf))
            rest = rest[label[rest] != label[x]]
            rest = rest[100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x])]
            if len(rest):
                rest = rest[(sig[rest] == sig[x]).mean(1) >= min_agreement]
            if len(rest):
                rest = rest[keys[x][(keys[rest] == keys[x]).argmax(1)] == k]
            for y in rest.tolist():
                p, q = joined.top(label[x]), joined.top(label[y])
                if p == q:
                    continue
                same = len(np.intersect1d(items[x], items[y], assume_unique=True))
                if 100 * same >= percent * (len(items[x]) + len(items[y]) - same):
                    joined[p] = q
                    u.append(node[x])
                    v.append(node[y])
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return dealt.groupBy("k", "i", "j").applyInPandas(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame, words_in: int = 5, percent: int = 75, bands: int = 48, rows: int = 5, min_agreement: float = 0.62, star_rounds: int = 1, large: int = 32, filter_bits: int = 24
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    min_agreement is the share of equal minima below which a pair is ruled out: 4.7 standard deviations under 0.75 with 240
    minima. Key groups of more than large members are first thinned by star_rounds rounds with one centre each. In one round a node
    already meets the centres of all its keys.
    """
    signed = materialise(signatures(docs, words_in, bands, rows), "signed")
    some = signed.where("node is not null")
    exploded = some.select(F.explode("keys").alias("k"), "node", F.col("n_shingles").alias("n"))
    shared_keys = exploded.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("k")
    members = materialise(exploded.join(shared_keys, "k").distinct(), "members")
    sizes = members.groupBy("k").agg(F.count("*").alias("c"))
    # A bitmap spares the signatures of nodes that share no key; the join takes out what it lets through in vain.
    likely = in_bitmap(some.select("doc_id", "node", "keys", "sig"), bitmap_of(members.select(F.col("node").alias("rep")), filter_bits), filter_bits, column="node")
    wanted = likely.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    wanted = materialise(wanted.join(members.select("node"), "node", "left_semi"), "wanted")
    sets = materialise(full_sets(docs, wanted, words_in, filter_bits), "sets")
    linked = None

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows with the label of their node: the least node that links join it with, or itself."""
        return rows.withColumn("label", F.col("node")) if linked is None else rows.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def joined(found: DataFrame) -> DataFrame:
        """Labels of all linked nodes after the stored links (u, v)."""
        return components(found if linked is None else found.union(linked.select(F.col("node").alias("u"), F.col("label").alias("v"))), stored=True)

    crowded = materialise(members.join(sizes.where(F.col("c") > large), "k"), "crowded")
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    if not crowded.isEmpty():
        for turn in range(star_rounds):
            here = labelled(crowded)
            centres = here.groupBy("k").agg(F.min(F.struct(F.xxhash64("node", "k", F.lit(turn)), F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))).alias("c")).select("k", "c.a", "c.na", "c.la")
            centres = materialise(centres, "centres")  # without its aggregate, the join below can split a hot key
            stars = here.join(centres, "k").where("label <> la").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), "na", F.col("n").alias("nb"))
            linked = joined(materialise(confirmed(stars.where(fits).select("a", "b").distinct(), sets, percent, min_agreement), "stars"))

    here = labelled(members)
    by_label = here.groupBy("k", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    mixed = by_label.groupBy("k").agg(F.sum("m").alias("c"), F.sum("w").alias("w"), F.max(F.struct("m", "label", "w")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    parts = [x for n, of, all_ in (("n", "m", "c"), ("w", "w", "w")) for x in (F.col(f"most.{of}").alias(f"{n}_main"), (F.col(all_) - F.col(f"most.{of}")).alias(f"{n}_rest"))]
    here = here.join(materialise(mixed.select("k", "c", *parts, F.col("most.label").alias("main_label")), "mixed-keys"), "k")
    here = materialise(here.withColumn("main", F.col("label") == F.col("main_label")).drop("main_label"), "mixed")
    few = here.where(F.col("c") <= large)
    x = few.select("k", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = few.select("k", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    found = confirmed(x.join(y, "k").where(f"a < b and la <> lb and {fits}").select("a", "b").distinct(), sets, percent, min_agreement)
    many = here.where(F.col("c") > large)
    if not many.isEmpty():
        found = found.union(links_in_blocks(many.join(sets, "node"), percent, min_agreement))
    linked = joined(materialise(found, "links"))

    placed = labelled(signed.select("doc_id", "n_shingles", "node"))
    repeated = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("node").alias("m"), F.count("*").alias("n"))
    return _finish(placed, materialise(repeated.where("lo <> hi or (m > 0 and m < n)").select("doc_id"), "repeated-ids"))


def _finish(placed: DataFrame, repeated: DataFrame) -> DataFrame:
    """Component labels to least doc_ids. A doc_id that stands in several components joins them; repeated: the doc_ids whose
    rows have different sets."""
    least = materialise(placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "component-ids")
    out = placed.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if not repeated.isEmpty():
        moved = components(out.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")))
        moved = moved.select(F.col("node").alias("component_id"), F.col("label").alias("to"))
        out = out.join(moved, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("to", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, filter_bits: int = 24, **options) -> DataFrame:
    """The pipeline's filter: the row of each component that has the least doc_id stays (rows that repeat this doc_id stay with
    it). Rows that a bitmap clears stay where they are; the others meet the table of those that go."""
    verdict = near_duplicates(docs, filter_bits=filter_bits, **options)
    gone = materialise(verdict.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    bitmap = bitmap_of(gone.select(F.col("doc_id").alias("rep")), filter_bits)
    doubtful = in_bitmap(docs, bitmap, filter_bits).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return in_bitmap(docs, bitmap, filter_bits, False).union(doubtful)
