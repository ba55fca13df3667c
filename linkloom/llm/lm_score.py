"""Cross-entropy difference between a target and a background n-gram model.

Both are interpolated bigram models over one vocabulary, that of a public byte-level tokenizer, with the same order and
smoothing; the target model counts the documents of the target set, the background model all documents. Every token and every
pair of neighbours counts: nothing is left out of the vocabulary, and each model's probabilities sum to one after any token.

The texts are cut into tokens once, in blocks of about block_tokens. A block sends each of its distinct pairs with its counts
to the pair's shard, the shard adds up the counts of all blocks and answers each of them, and the block scores its texts. What
is shuffled are distinct pairs a block and the token ids themselves, never texts but those that may be in the target set. The
counts of single tokens (as many as the vocabulary has, whatever the input) are the only thing that is broadcast.

Defined results: a null or empty text has no tokens and null losses and score. An empty target set makes the target model
uniform over the vocabulary; an empty table gives an empty result. A very long text is a block of its own; runs of over 2048
characters without white space are cut there before they become tokens. Repeated rows get equal results. A doc_id of null is
in no target set. Columns of docs but doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.byte_bpe import read_ranks
from linkloom.llm.common import bitmap_of, blocks, give_back, in_bitmap, materialise

LONG_RUN = re.compile(r"\S{2049}")
PARTS = re.compile(r"\S{1,2048}|\s+")
BLOCK = "block long, doc_ids array<long>, lens array<int>, good binary, ids binary"
RESULT = "doc_id long, n_tokens long, loss_target double, loss_background double"


@lru_cache(2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    out = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    if out.n_vocab >= 1 << 16:
        raise ValueError("pairs of tokens must fit into 32 bits")
    return out


def token_ids(text: str | None, coder) -> np.ndarray:
    found = []
    for block in blocks(text or "", 1 << 18):
        for part in PARTS.findall(block) if LONG_RUN.search(block) else (block,):
            found.append(coder.encode_to_numpy(part, disallowed_special=()).astype("<u2"))
    return np.concatenate(found) if found else np.zeros(0, "<u2")


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the blocks, of which a batch holds many: only one is taken out at a time. The worker's tokenizer is done with."""
    encoding.cache_clear()
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def distinct_pairs(pairs: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, how often each stands there, and how often with a flag: one sort in place, no positions."""
    x = pairs.astype(np.uint64)
    x <<= np.uint64(1)
    x |= good
    x.sort()
    flags = (x & np.uint64(1)).astype(np.uint32)
    x >>= np.uint64(1)
    pairs = x.astype(np.uint32)
    del x
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1])))
    n = np.diff(np.append(first, len(pairs))).astype(np.uint32)
    return pairs[first], n, np.add.reduceat(flags, first).astype(np.uint32) if len(first) else n


def token_blocks(rows: DataFrame, ranks_path: str, pattern: str, block_tokens: int) -> DataFrame:
    """Blocks of the rows (doc_id, good, text): ids of the rows, their lengths in tokens, flags, and the 16-bit token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, n, held = encoding(ranks_path, pattern), TaskContext.get().partitionId() << 33, []

        def block() -> pa.RecordBatch:
            ids, good, tokens = zip(*held, strict=True)
            columns = [[n], [list(ids)], [[len(x) for x in tokens]], [bytes(good)], [np.concatenate(tokens).tobytes()]]
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "doc_ids", "lens", "good", "ids"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).to_pydict()
                for doc_id, good, text in zip(part["doc_id"], part["good"], part["text"], strict=True):
                    held.append((doc_id, good, token_ids(text, coder)))
                    size += len(held[-1][2])
                    if size >= block_tokens or len(held) >= 1 << 16:
                        yield block()
                        n, held, size = n + 1, [], 0
        if held:
            yield block()
        held = batch = part = None
        give_back()

    return rows.select("doc_id", "good", "text").mapInArrow(run, BLOCK)


class Counts:
    """How often each token stands anywhere, and before another one, in the target set and in all documents.

    The last place of the second counts is the start of a text.
    """

    def __init__(self, anywhere: np.ndarray, before: np.ndarray, weight: float, smoothing: float):
        self.anywhere, self.before, self.weight, self.smoothing = anywhere, before, weight, smoothing
        self.start = anywhere.shape[1]

    def losses(self, pairs: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Nats of the second token of each pair under the target and under the background model."""
        out, a, b = [], pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)
        for n, anywhere, before in zip(counts, self.anywhere, self.before, strict=True):
            p = (anywhere[b] + self.smoothing) / (anywhere.sum() + self.smoothing * self.start)
            first = before[a]
            out.append(-np.log(np.where(first > 0, (1 - self.weight) * p + self.weight * n / np.maximum(first, 1), p)))
        return out


def pairs_of(lens: np.ndarray, ids: np.ndarray, start: int) -> np.ndarray:
    """Token before (start at the beginning of a text) and token, in one number each."""
    before = np.empty(len(ids), np.uint32)
    before[1:] = ids[:-1]
    before[(np.cumsum(lens) - lens)[lens > 0]] = start
    return before << np.uint32(16) | ids


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def token_counts(tokens: DataFrame, vocabulary: int, weight: float, smoothing: float) -> Counts:
    """Sums in each task, then over the tasks: twice the vocabulary's size of rows reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((4, vocabulary + 1), np.int64)
        for row in one_by_one(batches):
            lens, ids = np.array(row["lens"], np.int64), np.frombuffer(row["ids"], "<u2")
            good = np.repeat(np.frombuffer(row["good"], np.uint8), lens).astype(bool)
            first = pairs_of(lens, ids, vocabulary) >> np.uint32(16)
            for k, x in enumerate((ids[good], ids, first[good], first)):
                n[k] += np.bincount(x, minlength=vocabulary + 1)
        row = ids = good = first = x = None
        give_back()
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c[at]) for c in n]], ["token", "t", "b", "tf", "bf"])

    rows = tokens.select("lens", "good", "ids").mapInArrow(run, "token long, t long, b long, tf long, bf long")
    sums = rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("t", "b", "tf", "bf")]).toArrow()
    n = np.zeros((4, vocabulary + 1), np.float64)
    for k, c in enumerate(("t", "b", "tf", "bf")):
        n[k, sums["token"].to_numpy()] = sums[c].to_numpy()
    return Counts(n[:2, :vocabulary], n[2:], weight, smoothing)


def pair_counts(tokens: DataFrame, vocabulary: int, shards: int) -> DataFrame:
    """Answers of the shards to the blocks: block, shard, and the counts of the block's pairs there over all blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            lens = np.array(row["lens"], np.int64)
            pairs, n, good = distinct_pairs(pairs_of(lens, np.frombuffer(row["ids"], "<u2"), vocabulary), np.repeat(np.frombuffer(row["good"], np.uint8), lens))
            shard = shard_of(pairs, shards)
            order = np.argsort(shard, kind="stable")
            found, first = np.unique(shard[order], return_index=True)
            columns = [found, np.full(len(found), row["block"])]
            for values in (pairs, n, good):
                columns.append([part.tobytes() for part in np.split(values[order], first[1:])] if len(found) else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["shard", "block", "pairs", "n", "good"])
        row = lens = pairs = n = good = shard = order = columns = values = None
        give_back()

    def add(rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in rows["pairs"].to_pylist()]
        pairs = np.unique(np.concatenate(sent))
        places, sums = [np.searchsorted(pairs, x).astype(np.uint32) for x in sent], []
        for c in ("good", "n"):
            total = np.zeros(len(pairs), np.int64)
            for at, x in zip(places, rows[c].to_pylist(), strict=True):
                total[at] += np.frombuffer(x, np.uint32)  # a block sends each of its pairs once
            sums.append([total[at].tobytes() for at in places])
        target, background = sums
        return pa.table({"block": rows["block"], "shard": rows["shard"], "target": pa.array(target, pa.binary()), "background": pa.array(background, pa.binary())})

    sent = tokens.select("block", "lens", "good", "ids").mapInArrow(send, "shard long, block long, pairs binary, n binary, good binary")
    return sent.groupBy("shard").applyInArrow(add, "block long, shard long, target binary, background binary")


def score(tokens: DataFrame, answers: DataFrame, shared, shards: int) -> DataFrame:
    """Mean losses a token of every row of the blocks."""

    def one(block: pa.Table, counted: pa.Table) -> pa.Table:
        model, row = shared.value, block.to_pylist()[0]
        lens = np.array(row["lens"], np.int64)
        pairs, at = np.unique(pairs_of(lens, np.frombuffer(row["ids"], "<u2"), model.start), return_inverse=True)
        counted = counted.sort_by("shard")
        order, counts = np.argsort(shard_of(pairs, shards), kind="stable"), []
        for c in ("target", "background"):
            n = np.empty(len(pairs), np.float64)
            n[order] = np.frombuffer(b"".join(counted[c].to_pylist()), np.int64)
            counts.append(n)
        text = np.repeat(np.arange(len(lens)), lens)
        with np.errstate(invalid="ignore"):
            x, y = (np.bincount(text, loss[at], len(lens)) / lens for loss in model.losses(pairs, tuple(counts)))
        none = lens == 0
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": lens, "loss_target": pa.array(x, mask=none), "loss_background": pa.array(y, mask=none)})

    return tokens.select("block", "doc_ids", "lens", "ids").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, RESULT)


def marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, good (1 or 0) and text of every row. Only texts that may be good are shuffled: a bitmap of a fixed size tells."""
    bits = 24
    bitmap, rows = bitmap_of(good.withColumnRenamed("doc_id", "rep"), bits), docs.select("doc_id", "text")
    likely = in_bitmap(rows, bitmap, bits).join(good.withColumn("good", F.lit(1)), "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(0)).alias("good"), "text")
    return in_bitmap(rows, bitmap, bits, False).select("doc_id", F.lit(0).alias("good"), "text").union(likely)


def difference(
    docs: DataFrame, labels: DataFrame, ranks_path: str, pattern: str, block_tokens: int = 1 << 21, shard_tokens: int = 1 << 22, weight: float = 0.6, smoothing: float = 0.5
) -> DataFrame:
    """Scores all documents against the target set: documents with a label of quality 1.

    Rows: doc_id, n_tokens, mean losses a token under both models and score, their difference (low: like the target).
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    tokens = materialise(token_blocks(marked(docs, good), ranks_path, pattern, block_tokens), "tokens")
    vocabulary = encoding(ranks_path, pattern).n_vocab
    counts = token_counts(tokens, vocabulary, weight, smoothing)
    shards = 1 + int(counts.anywhere[1].sum()) // shard_tokens
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    out = score(tokens, pair_counts(tokens, vocabulary, shards), shared, shards)
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
