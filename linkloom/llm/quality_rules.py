"""Quality rules with an isolation forest over their statistics.

One pass over the texts gives each document its rule statistics. An isolation forest scores them: anomalous statistics are
isolated by few random splits. Its trees hold a bounded sample of labelled rows of good quality, and draw their splits over the
box that all labelled rows span, good and bad; a statistic that no good row varies in thus still parts the others off. The
threshold is the one that best parts all good from all bad labelled rows, while no more than a bounded share of the good ones
exceeds it.

Defined results: a null, empty or white-space text has no words and fails the base rule. With fewer than 20 good labelled
rows, as in an empty table, the forest rejects nothing. Very long texts are read whole. Statistics that tie with the threshold
are kept. Repeated rows get equal results; labels of a document that disagree count as not good. Columns of docs but doc_id
and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import bitmap_of, filter_by_text, hits, map_batches, materialise

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words")
UPPER, DIGITS, MARKS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!\"'(),-./:;?@[]_`{}~"))


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window which occurs more than once."""
    if len(ids) < window:
        return 0
    number = np.zeros(len(ids) - window + 1, np.int64)
    for k in range(window):  # numbered anew each time: no product can overflow
        _, number = np.unique(number * (int(ids.max()) + 1) + ids[k : len(ids) - window + 1 + k], return_inverse=True)
    twice = np.bincount(number)[number] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : len(ids) - window + 1 + k] |= twice
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[list[int], list[float]]:
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes.split takes ASCII white space only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    w, c = max(1, n), max(1, chars)
    without = lambda x: (len(data) - len(data.translate(None, x))) / c
    shares = [chars / w, math.log1p(symbols / w), math.sqrt(dup / max(1, lines)), math.sqrt(repeats / w), without(UPPER), math.sqrt(without(DIGITS)), without(MARKS)]
    shares += [len(numbers) / w**0.8, math.log1p(n / max(1, lines))]
    return [n, chars, symbols, dup, repeats], shares


class IsolationForest:
    """Trees of random splits in arrays; leaves add the expected depth of the rows they hold.

    A split is drawn evenly over a side of the node's part of the box (the rows' own one by default), and one side of it may
    hold no row.
    """

    def __init__(self, rows: np.ndarray, box: tuple[np.ndarray, np.ndarray] | None = None, trees: int = 100, sample: int = 512, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(rows)))
        low, high = box if box is not None else (rows.min(0), rows.max(0))
        self.trees = [self._grow(rows[draw.choice(len(rows), self.sample, replace=len(rows) < self.sample)], low, high, draw) for _ in range(trees)]

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, draw) -> tuple[np.ndarray, ...]:
        limit, feature, cut, child, depth = math.ceil(math.log2(self.sample)), [], [], [], []
        todo = [(rows, low, high, 0, -1)]
        while todo:
            part, low, high, level, parent = todo.pop()
            at = len(feature)
            if parent >= 0:
                child[parent].append(at)
            open_ = np.flatnonzero(high > low)
            if level >= limit or len(part) < 2 or not len(open_):
                feature.append(-1), cut.append(0.0), child.append([0, 0]), depth.append(level + self.expected(len(part)))
                continue
            f = int(draw.choice(open_))
            c = float(draw.uniform(low[f], high[f]))
            feature.append(f), cut.append(c), child.append([]), depth.append(0.0)
            below, above = high.copy(), low.copy()
            below[f] = above[f] = c
            todo += [(part[part[:, f] >= c], above, high, level + 1, at), (part[part[:, f] < c], low, below, level + 1, at)]  # the left one is taken first
        return np.array(feature), np.array(cut), np.array(child), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus mean path length over its expectation: near 1 is anomalous."""
        total = np.zeros(len(rows))
        for feature, cut, child, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(64):
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                here = at[inner]
                right = rows[inner, f[inner]] >= cut[here]
                at[inner] = child[here, right.astype(np.int64)]
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / self.expected(self.sample))


def rule_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), bitmap=None, bits: int = 0) -> DataFrame:
    """Columns keep, the base counts and the shares of every row; with a bitmap only of those whose doc_id may be in it."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField(c, T.DoubleType()) for c in SHARES]

    def make():
        def call(batch: dict) -> dict:
            if bitmap is not None:
                held = hits(np.array([0 if d is None else d for d in batch["doc_id"]], np.int64), bitmap.value, bits)
                batch = {c: [v for v, h in zip(batch[c], held, strict=True) if h] for c in batch}
            out = {c: batch[c] for c in keep} | {c: [] for c in (*BASE, *SHARES)}
            for text in batch["text"]:
                base, shares = statistics_of(text)
                for c, v in zip((*BASE, *SHARES), (*base, *shares), strict=True):
                    out[c].append(v)
            return out

        return call

    return map_batches(docs.select(*dict.fromkeys((*keep, "text"))), make, T.StructType(fields))


def fails_base() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def anomalies(stats: DataFrame, forest: IsolationForest | None, keep: tuple[str, ...] = ("doc_id", *BASE)) -> DataFrame:
    """Columns keep and anomaly of every row of statistics; 0 without a forest."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # trees x 2 x sample nodes

    def make():
        trees = shared.value

        def call(batch: dict) -> dict:
            table = np.array([batch[c] for c in SHARES], np.float64).T
            return {c: batch[c] for c in keep} | {"anomaly": trees.score(table) if trees else np.zeros(len(table))}

        return call

    return map_batches(stats.select(*keep, *SHARES), make, T.StructType([*[stats.schema[c] for c in keep], T.StructField("anomaly", T.DoubleType())]))


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id and good (1 or 0) of every labelled document; labels that disagree count as not good."""
    return labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.when(F.col("q") == 1, 1).otherwise(0).alias("good"))


def threshold(histogram: list[tuple[int, int, int]], reject: float, lose: float, bins: int) -> float:
    """From (step, good rows, bad rows): of the thresholds that no more than the share lose of the good rows exceeds, the one
    with the best balanced accuracy (the share of bad rows above less that of good rows above); the highest of equals.
    Without bad rows it is the least that no more than the share reject of the good ones exceeds."""
    n_good, n_bad = (sum(h[k] for h in histogram) for k in (1, 2))
    good = bad = 0
    best, most = 0.0, bins
    for at, g, b in sorted(histogram, reverse=True):
        if not n_bad:
            most = at
        good, bad = good + g, bad + b
        if good > (lose if n_bad else reject) * n_good:
            break
        gain = bad / n_bad - good / n_good if n_bad else 0.0
        if gain > best:
            best, most = gain, at - 1
    return most / bins


def calibrate(stats: DataFrame, labels: DataFrame, max_labelled: int = 20_000, reject: float = 0.005, lose: float = 0.02, bins: int = 100_000) -> tuple[IsolationForest | None, float]:
    """Forest and threshold, from the labelled rows that pass the base rule.

    The forest grows on at most max_labelled good ones, chosen by a hash, in the box of all good and bad ones. The threshold is
    set by all of them: a step of bins equal ones between 0 and 1, as threshold() says. Only histograms reach the driver. Fewer than 20 good
    rows make no forest, and nothing is rejected by it.
    """
    both = materialise(stats.where(~fails_base()).join(labels_of(labels), "doc_id").select("doc_id", "good", *SHARES), "labelled-statistics")
    rows = both.where("good = 1")
    n, scale = rows.count(), 1 << 20
    if n < 20:
        return None, 1.0
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", *SHARES), F.lit(scale)) < min(scale, math.ceil(max_labelled / n * scale)))
    fit = chosen.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", *SHARES).limit(max_labelled).select(*SHARES).collect()
    ends = both.agg(*[f(c) for f in (F.min, F.max) for c in SHARES]).first()
    forest = IsolationForest(np.array([list(r) for r in fit]), (np.array(ends[: len(SHARES)]), np.array(ends[len(SHARES) :])))
    step = F.ceil(F.col("anomaly") * bins)
    histogram = anomalies(both, forest, ("good",)).groupBy(step.alias("step")).agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).collect()
    return forest, threshold([tuple(r) for r in histogram], reject, lose, bins)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly and kept of every row."""
    stats = materialise(rule_statistics(docs), "rule-statistics")
    forest, most = calibrate(stats, labels, **options)
    scored = anomalies(stats, forest)
    return scored.withColumn("base_failed", fails_base()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= most))


def keep_good(docs: DataFrame, labels: DataFrame, filter_bits: int = 24, **options) -> DataFrame:
    """The pipeline's filter: drops rows that the base rule or the forest rejects; columns stay.

    The forest is fitted in a pass of its own over the texts that may be labelled (a bitmap of a fixed size tells), and then
    each text is judged where it is read: only statistics are joined with labels, texts are never shuffled.
    """
    bitmap = bitmap_of(labels_of(labels).select(F.col("doc_id").alias("rep")), filter_bits)
    forest, most = calibrate(materialise(rule_statistics(docs, bitmap=bitmap, bits=filter_bits), "rule-statistics"), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees x 2 x sample nodes

    def make():
        trees = shared.value

        def call(texts: list) -> list:
            found = [statistics_of(t) for t in texts]
            fine = np.array([b[0] >= 50 and 100 * b[4] <= 50 * b[0] for b, _ in found], bool)
            if trees:
                fine &= trees.score(np.array([s for _, s in found], np.float64)) <= most
            return fine.tolist()

        return call

    return filter_by_text(docs, make)
