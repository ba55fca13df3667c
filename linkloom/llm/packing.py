"""Best-fit-decreasing packing of token sequences.

A segment tree over remaining capacities finds the tightest open bin for each piece in logarithmic time. Pieces are dealt
into shards of a bounded number of tokens, each packed by itself, so that no task holds more than one shard; a shard ends
with at most a few bins that are not full.

The ids are those of the tokenizer's own call, ``encode(text, add_special_tokens=False)``: a special string of the vocabulary
that stands in a text becomes its special id, as there.

Defined results: a null or empty text is one piece of length 1 (its end id); an empty table gives no piece. A very long text
is cut into pieces of capacity tokens, of which only the last may be shorter. Pieces of equal length are placed in the order of
doc_id (null first), piece and row. Repeated rows are packed each for itself. Columns but doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from functools import lru_cache
from itertools import groupby
from unicodedata import category, is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import blocks, map_batches, materialise


class BestFit:
    """Open bins by remaining capacity: leaf c of the tree counts the bins that have c left."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def _add(self, c: int, by: int) -> None:
        i = c + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least length that an open bin has, or -1."""
        i, count = length + self.size, self.count
        if count[i]:
            return length
        while i > 1:  # up to the first right sibling that holds a bin
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        c = self.tightest(length)
        if c < 0:
            at, c = self.n, self.capacity
            self.n += 1
        else:
            at = self.bins[c].pop()
            self._add(c, -1)
        if c > length:
            self.bins[c - length].append(at)
            self._add(c - length, 1)
        return at, self.capacity - c


COMMON_SPACE = re.compile(r"[ \t\n\r]+")
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
#: The characters that OTHER_SPACE finds: to look for each of them in a text takes less time than the pattern.
OTHER_SPACES = tuple(c for c in map(chr, range(0x3001)) if OTHER_SPACE.match(c))
OTHER_ASCII_SPACES = tuple(c for c in OTHER_SPACES if c.isascii())
#: White space to the tokenizer, too; to it, the four separators of ASCII are marks like others.
TO_SPACE = {ord(c): " " for c in OTHER_SPACES if c not in "\x1c\x1d\x1e\x1f"}
BASIC = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
WIDE = re.compile("[\U00010000-\U0010ffff]")
#: Characters of BASIC that Python's Unicode doesn't know, while the tokenizer's may.
UNKNOWN = re.compile("[" + "".join(c for c in BASIC if category(c) == "Cn") + "]")
#: What the steps below are right for. A vocabulary that says something else is refused.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def merge_engine(spec: dict):
    """tiktoken's engine with the merges of the vocabulary: a function from pieces, each with a space behind it, to their ids.

    The engine knows single bytes only. The last byte of a piece, which the vocabulary holds as a symbol of its own, is told by
    the space, which no piece holds; a byte and the space merge before all others.
    """
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(printable, map(chr, printable), strict=True)) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    vocabulary = spec["model"]["vocab"]
    end = spec["model"]["end_of_word_suffix"]
    written = {shown[b]: bytes((b,)) for b in range(256)} | {shown[b] + end: bytes((b, 0x20)) for b in range(256)}
    ranks = {data: vocabulary[symbol] for symbol, data in written.items()}
    for pair in spec["model"]["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        written[left + right] = written[left] + written[right]
        ranks[written[left + right]] = vocabulary[left + right]
    singles, merged = list(ranks.values())[:512], list(ranks.values())[512:]
    if merged != sorted(merged) or max(singles) > 511 or max(ranks[bytes((b,))] for b in range(256)) > min(ranks[bytes((b, 0x20))] for b in range(256)):
        raise ValueError("the ids do not follow the merges")
    if len(ranks) != 512 + len(spec["model"]["merges"]):
        raise ValueError("a merge holds white space, or two make the same symbol")
    # The engine looks for one special string at least; no line end is left in what it gets.
    encoding = tiktoken.Encoding("pieces", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\n": 1 << 30})

    def engine(pieces: str) -> bytes:
        return encoding.encode_to_numpy(pieces, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return engine


def piece_cutter(pattern: str):
    """A function that puts spaces round every piece of a lower-cased text that is no run of letters, if its only white space is
    the space: what is between spaces then are the pieces of the pattern."""
    import regex

    if pattern != PIECES:
        raise ValueError("not the pieces that this operator knows")

    def cutter(characters: str):
        letters, numbers = ("".join(f"{run[0]}-{run[-1]}" for run in regex.findall(kind, characters)) for kind in (r"\p{L}+", r"\p{N}+"))
        # The pattern without its runs of letters, led by one set of characters, which `re` finds fast.
        found = rf"[^ {letters}](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![{numbers}])[^ {letters}{numbers}]*|)"
        return re.compile(found).sub

    ascii, basic, wide = cutter(BASIC[:128]), cutter(BASIC), cutter(BASIC + "".join(map(chr, range(0x10000, 0x110000))))

    def cut(text: str) -> str:
        return (ascii if text.isascii() else wide if WIDE.search(text) else basic)(r" \g<0> ", text)

    return cut


@lru_cache(2)
def loaded(path: str):
    """(tokenizer, engine, cutter, special strings) of the vocabulary: of a fixed size, so a worker keeps them."""
    import json

    from tokenizers import Tokenizer

    with open(path) as f:
        spec = json.load(f)
    steps = spec["normalizer"].get("normalizers", [spec["normalizer"]])
    split = spec["pre_tokenizer"]["pretokenizers"]
    if steps != NORMALIZERS or [x["type"] for x in split] != ["Split", "ByteLevel"] or spec["model"]["type"] != "BPE" or any(x["normalized"] for x in spec["added_tokens"]):
        raise ValueError(f"{path}: neither the normaliser nor the pre-tokenizer that this operator knows")
    return Tokenizer.from_file(path), merge_engine(spec), piece_cutter(split[0]["pattern"]["Regex"]), tuple(x["content"] for x in spec["added_tokens"])


class Recent(dict):
    """A dictionary of two generations: when it has over room entries they become the old ones, and are found once more."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.old = room, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = value


def has_other_space(text: str) -> bool:
    for c in OTHER_ASCII_SPACES if text.isascii() else OTHER_SPACES:
        if c in text:
            return True
    return False


def small(text: str) -> str:
    """Lower-cased as the tokenizer does it; Python alone lowers a sigma at the end of a word in its own way."""
    return text.replace("\u03a3", "\u03c3").lower()


def is_plain(text: str) -> bool:
    """Whether Python can tell the normal form: marks may compose anew once their letter is small."""
    if text.isascii():
        return True
    if UNKNOWN.search(text) or any(category(c) == "Cn" for c in set(WIDE.findall(text))):
        return False
    return is_normalized("NFC", text) and is_normalized("NFC", small(text))


class ChunkIds(Recent):
    """Texts to their ids as little-endian 32-bit bytes. The vocabulary never merges over white space.

    A text whose normal form Python can tell is cut into pieces here, and all of them go through the engine in one call. Of any
    other text, the chunks between white space for which that can't be told go through the tokenizer itself, and recent ones are
    kept. So does a whole text that holds one of the vocabulary's special strings: as in the tokenizer's own call, they become
    special ids.
    """

    def __init__(self, path: str, room: int = 100_000):
        super().__init__(room)
        self.tokenizer, self.engine, self.cut, self.special = loaded(path)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.by_tokenizer(chunk)
        if len(chunk) <= 64:  # longer ones hardly come again
            self.keep(chunk, ids)
        return ids

    def by_tokenizer(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_plain(self, text: str) -> bytes:
        return self.engine(self.cut(small(text).replace("\n", " ").replace("\t", " ").replace("\r", " ")) + " ")

    def of_block(self, text: str) -> bytes:
        if has_other_space(text):
            text = text.translate(TO_SPACE)
        if is_plain(text):
            return self.of_plain(text)
        runs = groupby(filter(None, COMMON_SPACE.split(text)), is_plain)
        return b"".join(self.of_plain(" ".join(run)) if plain else b"".join(map(self.__getitem__, run)) for plain, run in runs)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.by_tokenizer(text)
        return b"".join(map(self.of_block, blocks(text)))


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and uid, a number of its own."""

    def make():
        from pyspark import TaskContext

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are hashed as little-endian 32-bit numbers")
        coder, end = ChunkIds(tokenizer_path), array("I", [end_id]).tobytes()
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 33

        def call(batch: dict) -> dict:
            nonlocal uid
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "uid")}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview(coder.encode(text or "") + end)
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for k, v in zip(out, (doc_id, piece, start, len(part) // 4, zlib.crc32(part), uid), strict=True):
                        out[k].append(v)
                    uid += 1
            return out

        return call

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def pack(pieces: DataFrame, capacity: int = 4096, shard_tokens: int = 1 << 24, shard_pieces: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length and a stored uid. Shards hold about shard_tokens tokens."""
    size = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    shards = max(1, -(-size["tokens"] // shard_tokens), -(-size["n"] // shard_pieces))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True])
        tree = BestFit(capacity)
        placed = np.array([tree.place(n) for n in pdf["length"].tolist()], np.int64).reshape(-1, 2)
        return pdf.assign(sequence_id=pdf["shard"].to_numpy() * (1 << 31) + placed[:, 0], offset=placed[:, 1])[[c.split()[0] for c in schema.split(", ")]]

    return pieces.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).groupBy("shard").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Rows of tokenise() with sequence_id and offset."""
    return pack(materialise(tokenise(docs, tokenizer_path, capacity), "pieces"), capacity)
