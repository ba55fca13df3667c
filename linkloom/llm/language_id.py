"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its character 5-grams, then 4-grams
and so on down to single characters: the longest order with a known n-gram decides.

The model holds every word and n-gram of the rows it is fitted on; only the number of these rows is bounded, by a parameter.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Languages that tie go to the first in
alphabetical order. With no labelled row at all, every row is ``und``; an empty table gives an empty result. Very long texts
are scored whole, block by block. Repeated rows get equal results. Columns of docs but those named are not looked at.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import blocks, filter_by_text, map_batches, materialise

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")  # runs of letters


class WordBackoff:
    """The model: rows of log probabilities by language for words and for character n-grams."""

    def __init__(self, counts: list[tuple[str, str, int]], orders: int = 5, min_gram_count: int = 3, smoothing: float = 0.5):
        """counts: (language, word, occurrences). N-grams of two and more characters count from min_gram_count occurrences on."""
        self.languages = sorted({lang for lang, _, _ in counts})
        self.orders = orders
        column = {lang: k for k, lang in enumerate(self.languages)}
        row: dict[str, int] = {}
        at = np.fromiter((row.setdefault(word, len(row)) for _, word, _ in counts), np.int64, len(counts))
        by_lang = np.zeros((len(row), len(column)))
        np.add.at(by_lang, (at, np.fromiter((column[lang] for lang, _, _ in counts), np.int64, len(counts))), np.fromiter((n for _, _, n in counts), np.float64, len(counts)))
        self.words, tables = {}, []
        self._add(list(row), by_lang, self.words, tables, smoothing)
        self.grams: list[dict[str, int]] = []
        for k in range(1, orders + 1):
            number: dict[str, int] = {}
            owner, at = array("q"), array("q")
            for word, i in row.items():
                for gram in self.grams_of(word, k):
                    at.append(number.setdefault(gram, len(number)))
                    owner.append(i)
            found = np.stack([np.bincount(at, c[np.array(owner)], len(number)) for c in by_lang.T], 1) if len(at) else np.zeros((0, len(column)))
            keep = found.sum(1) >= (min_gram_count if k > 1 else 0)
            self.grams.append({})
            self._add([g for g, x in zip(number, keep, strict=True) if x], found[keep], self.grams[-1], tables, smoothing)
        self.log_p = np.concatenate(tables) if tables else np.zeros((0, 0), np.float32)

    @staticmethod
    def grams_of(word: str, n: int) -> list[str]:
        padded = f"^{word}$" if n > 1 else word
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    @staticmethod
    def _add(keys: list[str], counts: np.ndarray, into: dict[str, int], tables: list[np.ndarray], smoothing: float) -> None:
        if not keys:
            return
        first = sum(len(x) for x in tables)
        into.update((key, first + i) for i, key in enumerate(keys))
        total = counts.sum(0) + smoothing * (len(counts) + 1)
        tables.append(np.log((counts + smoothing) / total).astype(np.float32))

    def unseen(self, word: str) -> np.ndarray:
        """The row of a word that is not in the model: the mean over its known n-grams of the longest order that has any."""
        for k in range(self.orders - 1, -1, -1):
            known = [row for g in self.grams_of(word, k + 1) if (row := self.grams[k].get(g)) is not None]
            if known:
                return self.log_p[known].mean(0)
        return np.zeros(len(self.languages), np.float32)


class Scorer(dict):
    """Word to row of a growing table; rows of unseen words are kept until there are too many."""

    def __init__(self, model: WordBackoff, room: int = 100_000):
        super().__init__(model.words)
        self.model, self.fixed = model, len(model.log_p)
        self.table = np.concatenate([model.log_p, np.zeros((room, len(model.languages)), np.float32)])
        self.used = self.fixed

    def __missing__(self, word: str) -> int:
        row = self.used
        self.table[row] = self.model.unseen(word)
        self.used += 1
        self[word] = row
        return row

    def score(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.model.languages)), 0
        for block in blocks(text or "", 1 << 18):
            words = WORD.findall(block.lower())
            if self.used + len(words) > len(self.table):
                self.clear()
                self.update(self.model.words)
                self.used = self.fixed
            if words:
                total += self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
                n += len(words)
        if not n or not len(total):
            return UNDETERMINED, 0.0
        # The evidence of at most 20 average words: a sum over a long text would always be 0 or 1.
        rest = (total - total.max()) * min(1.0, 20 / n)
        best = int(rest.argmax())
        return self.model.languages[best], float(1 / math.fsum(np.exp(rest)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, max_rows_per_language: int = 300, seed: int = 7) -> WordBackoff:
    """Fits the model on rows (doc_id, text, lang) with a language.

    The fit is bounded by one parameter: about max_rows_per_language whole texts of each language, chosen by a hash of the row,
    are counted in Spark. All words of theirs, and so all languages, reach the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    scale = 1 << 30
    shares = labelled.groupBy("lang").agg(F.least(F.lit(scale), F.ceil(F.lit(float(max_rows_per_language) * scale) / F.count("*"))).alias("share"))
    place = F.pmod(F.xxhash64("text", "doc_id", F.lit(seed)), F.lit(scale))
    sample = labelled.join(materialise(shares, "language-shares"), "lang").where(place < F.col("share")).select("lang", "text")

    def count():
        def call(batch: dict) -> dict:
            found: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for block in blocks(text):
                    for word, n in Counter(WORD.findall(block.lower())).items():
                        found[lang, word] += n
            return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

        return call

    counts = map_batches(sample, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    rows = zip(*(counts[c].to_pylist() for c in ("lang", "word", "n")), strict=True)
    return WordBackoff(sorted(rows))


def predict(docs: DataFrame, model: WordBackoff, keep: tuple[str, ...]) -> DataFrame:
    """Columns keep of docs, lang_pred and score of every row."""
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are names of the result")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's parameter

    def make():
        scorer = Scorer(shared.value)

        def call(batch: dict) -> dict:
            both = [scorer.score(t) for t in batch["text"]]
            return {n: batch[n] for n in keep} | {"lang_pred": [x[0] for x in both], "score": [x[1] for x in both]}

        return call

    schema = T.StructType([*(docs.schema[n] for n in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(docs.select(*dict.fromkeys((*keep, "text"))), make, schema)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Learns from rows with a language that aren't held out."""
    marked = docs.select("doc_id", "text", "lang", is_held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where(~F.col("held_out")), **bounds)
    return predict(marked.select("doc_id", "held_out", "text"), model, ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, min_score: float = 0.5, **bounds) -> DataFrame:
    """The pipeline's filter: drops rows without a letter or whose best language has less than min_score; columns stay, also
    such as are named like this module's own. Without any labelled row it drops only rows without a letter."""
    model = train(docs.select("doc_id", "text", "lang").where(~is_held_out(F.col("doc_id"))), **bounds)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's parameter

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [lang != UNDETERMINED and score >= min_score for lang, score in map(scorer.score, texts)]

    return filter_by_text(docs, make)
