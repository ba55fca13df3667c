"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the contracts: runs of anything but ASCII white space, as a Java and DuckDB pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session of one machine (tests) gets its own where none is set; a cluster has to
    name one, as a folder of one machine would lose what the others wrote."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns free memory of a worker to the system, so that what a stage needed isn't held through the next ones."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | T.StructType) -> DataFrame:
    """Runs make() once a task, then the function it returns on every Arrow batch: columns as lists in, columns as lists out."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            # Few rows at a time: a batch may hold very long texts, and its results are built beside it.
            for at in range(0, batch.num_rows, 512):
                out = call(batch.slice(at, 512).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        del call
        out = batch = None
        give_back()

    return df.mapInArrow(run, struct)


def filter_by_text(df: DataFrame, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows for whose texts the function that make() returns says true: a list of texts in, a list of flags out. Rows and
    columns pass as they are, whatever the names of the others than ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(call(part.column("text").to_pylist()), pa.bool_()))
        del call
        part = batch = None
        give_back()

    return df.mapInArrow(run, df.schema)


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cuts a very long text behind ASCII white space, so that no word is split unless it is itself longer than size."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in " \n\t\r") + 1
        if cut <= at:  # one word over the whole block: go on to its end
            ends = [x for x in (text.find(c, at + size) for c in " \n\t\r") if x >= 0]
            if not ends:
                break
            cut = min(ends) + 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def id_bits(doc_ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def bitmap_of(wanted: DataFrame, bits: int):
    """A broadcast bitmap of the hashes of the doc_ids in column rep: 2^bits bits, however many there are."""

    def make():
        def call(batch: dict) -> dict:
            h = id_bits(np.array(batch["rep"], np.int64), bits)
            return {"w": (h >> np.uint64(6)).astype(np.int64), "b": (np.uint64(1) << (h & np.uint64(63))).astype(np.int64)}

        return call

    words = map_batches(wanted.select(F.coalesce("rep", F.lit(0)).alias("rep")), make, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint64)
    return wanted.sparkSession.sparkContext.broadcast(out)


def hits(doc_ids: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    h = id_bits(doc_ids, bits)
    return ((words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def in_bitmap(df: DataFrame, bitmap, bits: int, wanted: bool = True, column: str = "doc_id") -> DataFrame:
    """The rows whose doc_id (or that column) may be in the bitmap (a join takes the others out), or those for which it can't be. It saves
    shuffling rows that nothing wants."""

    def run(batches):
        words = bitmap.value
        for batch in batches:
            yield batch.filter(pa.array(hits(batch.column(column).fill_null(0).to_numpy(zero_copy_only=False), words, bits) == wanted))

    return df.mapInArrow(run, df.schema)
