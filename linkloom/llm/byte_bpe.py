"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at byte i, with i behind it, and inner nodes hold the smaller of
their children; the root thus is the leftmost pair of the least rank. A merge changes at most three leaves: its own, its
live left neighbour's and that of the part it swallows.

Defined results: a null text counts as empty: no ids, and the hashes of the empty string. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from linkloom.llm.common import map_batches

NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one match of the pattern."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n, get = len(piece), ranks.get
    size = 1 << max(1, n - 1).bit_length()
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
    before = list(range(-1, n - 1))  # before[i]: where the part to its left starts
    # A node holds rank * 2^32 + place, so that the least is the leftmost of the least rank and tells its place.
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (least := tree[1]) < NONE:
        i = least & 0xFFFFFFFF
        gone = end[i]
        stop = end[i] = end[gone]
        rank = None
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]])
        changed = [(gone, NONE), (i, NONE if rank is None else rank << 32 | i)]
        if (left := before[i]) >= 0:
            rank = get(piece[left:stop])
            changed.append((left, NONE if rank is None else rank << 32 | left))
        for at, value in changed:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(ids)


class Coder:
    """Encoder with the ids of recent matches kept, and decoder."""

    def __init__(self, path: str, pattern: str, room: int = 800_000):
        import regex

        self.ranks, self.pattern, self.room = read_ranks(path), regex.compile(pattern), room
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.kept: dict[str, tuple[int, ...]] = {}

    def of_match(self, match: str) -> tuple[int, ...]:
        ids = self.kept.get(match)
        if ids is None:
            ids = merge(match.encode(), self.ranks)
            if len(match) <= 64:
                if len(self.kept) > self.room:
                    self.kept.clear()
                self.kept[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text. The pattern looks past a match's end, so a text isn't cut before it."""
        return list(chain.from_iterable(map(self.of_match, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of the decoded bytes, and the ids themselves if asked for."""

    def make():
        bpe = coder(ranks_path, pattern)

        def call(batch: dict) -> dict:
            out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for text in batch["text"]:
                ids = bpe.encode(text or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return call

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
