"""WARC archives with revisit records.

Only headers (page, payload digest, size) are shuffled by digest: an aggregate finds the response of every digest, and a
join by digest tells the other pages which one they revisit. The pages then go once, with their payload, to the tasks that
write archives: gzip members of one record each, with fresh headers. Archives are read back as streams, record by record.

Writers finish a file under a name of their own and then rename it, so a repeated task leaves the same archive.

A response's block is an HTTP response, whose payload follows its head. A revisit names its response by target, page and, where
that page stands in one row only, by record id.

Defined results: a null html has an empty payload. Payloads under min_bytes are always responses. Rows that repeat the
page_id of a response with the same payload tie with it and are responses too. A row without a page_id revisits the page with
the largest one; where no row of a payload has a page_id, all are responses. Very long pages are written and read whole. An
empty table gives no archive and no record. Columns but page_id, url and html are not looked at, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import materialise, shared_path

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def header_value(url: str) -> str:
    return "".join(c if c.isprintable() else "%0A" for c in url)


def record(page_id, url, payload: bytes, digest: str, note: dict | None = None, place: str = "") -> bytes:
    """One record. A revisit has no block of its own: its headers name the response and the payload's digest and size.

    note: what resolve() says about the row, if anything. place: file and number, which part the records of a repeated row.
    """
    note = note or {}
    refers_to = note.get("refers_to")
    kind = "response" if refers_to is None else "revisit"
    block = HTTP.format(len(payload)).encode() + payload if kind == "response" else b""
    own = record_id(page_id, digest, place) if note.get("copies", 1) > 1 else record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + header_value(url))
    head += [f"X-Page-Id: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}", f"WARC-Refers-To-Date: {DATE}"]
        if note["refers_url"]:
            head.append("WARC-Refers-To-Target-URI: " + header_value(note["refers_url"]))
        if note["refers_copies"] == 1:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream. A file that ends inside a record raises ValueError."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(n := int(head["Content-Length"]))
        if len(block) < n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends inside a record")
        yield head, block


def resolve(heads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Notes on rows (page_id, url, digest, bytes), for revisits and for repeated rows only: page_id, digest, copies (rows that
    tie), refers_to (null for a response), and url and copies of that page. A digest's headers are counted by page first."""
    pages = heads.groupBy("digest", "page_id").agg(F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.max("url").alias("url"))
    last = F.max(F.struct("page_id", "url", "copies"))
    first = pages.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(last.alias("last"))
    found = pages.join(first, "digest", "left").withColumn("revisit", F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id")))
    of = lambda c: F.when(F.col("revisit"), F.col(f"last.{c}"))
    return found.where("revisit or copies > 1").select("page_id", "digest", "copies", of("page_id").alias("refers_to"), of("url").alias("refers_url"), of("copies").alias("refers_copies"))


def write_archives(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes every row (page_id, url, html) and returns the archives: path, records. They lie in the shared folder."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    heads = pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("bytes"))
    notes = materialise(resolve(heads, min_bytes), "revisits").select(F.col("page_id").alias("page"), F.col("digest").alias("d"), F.struct("copies", "refers_to", "refers_url", "refers_copies").alias("note"))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(notes, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "note")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, top = file_system(folder)
        files.create_dir(top, recursive=True)
        name, n = f"{top}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        own = f"{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64).to_pydict()
                    for row in zip(*(part[k] for k in ("page_id", "url", "payload", "digest", "note")), strict=True):
                        out.write(gzip.compress(record(*row, place=f"{name}:{n}"), 6, mtime=0))
                        n += 1
        if n:
            files.move(own, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": [n]})
        else:
            files.delete_file(own)

    return materialise(rows.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are those of the bytes read; a digest that differs from its header raises ValueError.
    """
    spark = archives.sparkSession
    struct = T.StructType.fromDDL(SCHEMA)
    n = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism * 64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = struct.fieldNames()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = file_system(path)
                rows = []
                with files.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in read_records(io.BufferedReader(stream, 1 << 16)):
                        digest, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Refers-To-Page")
                        size = int(head["X-Payload-Length"])
                        payload = block[block.find(b"\r\n\r\n") + 4 :] if refers is None else b""
                        if refers is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append((int(head["X-Page-Id"]) if head["X-Page-Id"] else None, size, digest, head["WARC-Type"], None if refers is None else int(refers)))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    return archives.select("path").repartition(n, "path").mapInArrow(read, struct)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    return read_archives(write_archives(pages, min_bytes))
