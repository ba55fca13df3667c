"""Media columns: signature sniffing with Aho-Corasick and format validators.

One automaton finds all magic bytes in a byte string. A validator for each format walks its structure from there and tells
where it ends; only valid finds count. The find at the start corrects the declared type, others are embedded media.

The automaton finds end marks as well, so a validator looks them up instead of searching: the first of a kind behind a place by
bisection, and for ZIP the one whose directory leads back to that place.

Defined results: null bytes are empty; bytes without a valid find have the type application/octet-stream. A find inside the
bytes of a longer valid find is embedded media of it; finds that start at the same place are ordered by length, then type. A PDF
ends at the last end mark with a valid trailer before the next PDF. A null or empty text is one multiple of spaces; very long
texts are stored and read whole. Equal bytes give equal results, an empty table an empty one. Columns but those named are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkloom.llm.common import map_batches

UNKNOWN = "application/octet-stream"


class Bytes:
    """Bytes with the places of the end marks in them."""

    def __init__(self, data: bytes, marks: dict[bytes, list[int]]):
        self.data, self.view, self.marks = data, memoryview(data), marks
        self.zips: dict[int, int] | None = None

    def next(self, mark: bytes, at: int) -> int:
        """The first place of the mark from at on, or -1."""
        places = self.marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def zip_ends(self) -> dict[int, int]:
        """Where the archives end that end-of-directory records speak of, by where they start."""
        if self.zips is None:
            self.zips = {}
            for end in self.marks[ZIP_END]:
                if end + 22 > len(self.data):
                    continue
                size, offset, comment = struct.unpack_from("<IIH", self.data, end + 12)
                start, directory = end - size - offset, end - size
                if start >= 0 and self.data[directory : directory + 4] in (b"PK\x01\x02", ZIP_END) and end + 22 + comment <= len(self.data):
                    self.zips.setdefault(start, end + 22 + comment)
        return self.zips


# Marks of the formats.
JPEG_END, ZIP_END, PDF_END, PDF_START = b"\xff\xd9", b"PK\x05\x06", b"%%EOF", b"%PDF-"
END_MARKS = (JPEG_END, ZIP_END, PDF_END, PDF_START)
TRAILER = re.compile(rb"startxref\s+(\d+)\s+\Z")


def _png(data: Bytes, at: int) -> int:
    b = data.view
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return -1
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i
    return -1


def _gif(data: Bytes, at: int) -> int:
    b = data.view
    if at + 13 > len(b):
        return -1
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 <= len(b):
            flags = b[i + 9]
            i += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return -1
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return -1


def _jpeg(data: Bytes, at: int) -> int:
    b, i = data.view, at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if not (0xC0 <= kind <= 0xFE) or kind == 0xD8:
            return -1
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return -1
        i += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the end marker
            end = data.next(JPEG_END, i)
            return -1 if end < 0 else end + 2
    return -1


def _bmp(data: Bytes, at: int) -> int:
    b = data.view
    if at + 26 > len(b):
        return -1
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    fine = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size and at + size <= len(b)
    return at + size if fine else -1


def riff_chunks(b: memoryview, at: int):
    """Name, start and length of the chunks, or an exception if one leaves the file."""
    size = struct.unpack_from("<I", b, at + 4)[0]
    i, end = at + 12, at + 8 + size
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            raise ValueError("a chunk leaves the file")
        yield name, i + 8, n
        i += 8 + n + (n & 1)


def _riff(data: Bytes, at: int) -> tuple[int, str]:
    b = data.view
    if at + 12 > len(b):
        return -1, ""
    size = struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(bytes(b[at + 8 : at + 12]), "")
    if not kind or at + 8 + size > len(b):
        return -1, ""
    try:
        names = [name for name, _, _ in riff_chunks(b, at)]
    except (ValueError, struct.error):
        return -1, ""
    if not names or kind == "audio/wav" and not {b"fmt ", b"data"} <= set(names):
        return -1, ""
    return at + 8 + size, kind


def _gzip(data: Bytes, at: int) -> int:
    b = data.view
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return -1
    unpack, i = zlib.decompressobj(31), at
    try:
        while i < len(b) and not unpack.eof:
            part = b[i : i + 65536]
            unpack.decompress(part, 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            i += len(part)
    except zlib.error:
        return -1
    return i - len(unpack.unused_data) if unpack.eof else -1


def _zip(data: Bytes, at: int) -> int:
    return data.zip_ends().get(at, -1)


def _pdf(data: Bytes, at: int) -> int:
    after = data.next(PDF_START, at + 1)
    places = data.marks[PDF_END]
    k = bisect_left(places, after if after >= 0 else len(data.data))
    while k and places[k - 1] > at:  # from the last end mark back to the first with a trailer: each is looked at once
        k -= 1
        end = places[k]
        trailer = TRAILER.search(data.data[max(at, end - 64) : end])
        if trailer and len(trailer[1]) < 16 and at + int(trailer[1]) < end:
            table = data.data[at + int(trailer[1]) : at + int(trailer[1]) + 4]
            if table == b"xref" or table[:1].isdigit():
                return end + 5
    return -1


#: Magic bytes, the type, and the validator: the place behind the end, or -1. RIFF tells the type itself.
FORMATS: tuple[tuple[bytes, str, Callable], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "", _riff),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
)


@lru_cache(1)
def automaton():
    import ahocorasick

    words: dict[bytes, list[int]] = {}
    for k, mark in enumerate((*(magic for magic, _, _ in FORMATS), *END_MARKS)):
        words.setdefault(mark, []).append(k)
    out = ahocorasick.Automaton()
    for mark, numbers in words.items():
        out.add_word(mark.decode("latin-1"), (numbers, len(mark)))
    out.make_automaton()
    return out


def sniff(data: bytes | None) -> list[tuple[int, int, str]]:
    """Valid finds (start, length, type) by start."""
    data = data or b""
    starts, marks, out = [], {m: [] for m in END_MARKS}, []
    for last, (numbers, n) in automaton().iter(data.decode("latin-1")):
        for k in numbers:
            if k < len(FORMATS):
                starts.append((last - n + 1, k))
            else:
                marks[END_MARKS[k - len(FORMATS)]].append(last - n + 1)
    held = Bytes(data, marks)
    for at, k in starts:
        _, kind, walk = FORMATS[k]
        end = walk(held, at)
        if not kind:
            end, kind = end
        if end > 0:
            out.append((at, end - at, kind))
    return sorted(out)


def true_type(finds: list[tuple[int, int, str]]) -> str:
    return finds[0][2] if finds and finds[0][0] == 0 else UNKNOWN


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono PCM."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """Samples and their rate."""
    view, rate, out = memoryview(data), 0, b""
    for name, at, n in riff_chunks(view, 0):
        if name == b"fmt ":
            rate = struct.unpack_from("<I", view, at + 4)[0]
        elif name == b"data":
            out = bytes(view[at : at + n])
    return out, rate


EMBEDDED = "array<struct<start:long,length:long,type:string,data:binary>>"


def sniff_column(df: DataFrame, column: str = "media", declared: str = "declared_type", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, the declared type, true_type, mismatch and embedded (start, length, type, bytes) of every row's bytes."""
    fields = [df.schema[c] for c in dict.fromkeys((*keep, declared))]
    more = T.StructType.fromDDL(f"true_type string, mismatch boolean, embedded {EMBEDDED}").fields

    def make():
        def call(batch: dict) -> dict:
            out = {f.name: batch[f.name] for f in fields} | {"true_type": [], "mismatch": [], "embedded": []}
            for data, said in zip(batch[column], batch[declared], strict=True):
                finds = sniff(data)
                kind = true_type(finds)
                out["true_type"].append(kind)
                out["mismatch"].append(said != kind)
                out["embedded"].append([{"start": s, "length": n, "type": t, "data": data[s : s + n]} for s, n, t in finds if s])
            return out

        return call

    return map_batches(df.select(*dict.fromkeys((*keep, column, declared))), make, T.StructType([*fields, *more]))


def store_texts(docs: DataFrame, multiple: int = 192, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes, media and declared_type: the text's bytes, padded with spaces to a positive multiple, as a WAV file. It is
    declared as what it was made from, text/plain."""

    def make():
        def call(batch: dict) -> dict:
            raw = [(t or "").encode() for t in batch["text"]]
            padded = [b.ljust(max(multiple, -(-len(b) // multiple) * multiple), b" ") for b in raw]
            return {"doc_id": batch["doc_id"], "n_bytes": [len(b) for b in raw], "media": [wav(b, rate) for b in padded], "declared_type": ["text/plain"] * len(raw)}

        return call

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary, declared_type string")


def features_of(payload: bytes, rate: int) -> str:
    """Rate, samples, their mean, and how often neighbours lie on two sides of sample value 96."""
    x = np.frombuffer(payload, np.uint8)
    high = x > 96
    return f"rate={rate};samples={len(x)};mean={int(x.sum(dtype=np.int64)) / max(1, len(x)):.4f};crossings={int((high[1:] != high[:-1]).sum())}"


def digest(stored: DataFrame) -> DataFrame:
    """Sniffs the stored bytes, corrects their declared type, reads the samples and returns sizes, hashes and a feature string.

    feature: true type, features_of(), and embedded media as type@start+length:hash. Bytes that are no WAV file raise.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "embedded")

    def make():
        def call(batch: dict) -> dict:
            out = {c: batch[c] for c in ("doc_id", "n_bytes", "declared_type", "true_type", "mismatch")} | {c: [] for c in names}
            for data, kind, embedded in zip(batch["media"], batch["true_type"], batch["embedded"], strict=True):
                if kind != "audio/wav":
                    raise ValueError(f"stored as WAV, found {kind}")
                payload, rate = wav_samples(data)
                inside = ",".join(f"{e['type']}@{e['start']}+{e['length']}:{hashlib.sha256(e['data']).hexdigest()[:16]}" for e in embedded)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{kind};{features_of(payload, rate)};embedded={inside}", len(embedded))
                for c, v in zip(names, row, strict=True):
                    out[c].append(v)
            return out

        return call

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", declared_type string, true_type string, mismatch boolean, embedded int"
    return map_batches(sniff_column(stored, keep=("doc_id", "n_bytes", "media")), make, schema)
