"""What the text operators share: shared folders, Arrow batches cut to a byte bound, and words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstrata.sources.sinks import scratch_path

#: Text that one vectorised step works on; bounds a Python worker's memory whatever a batch holds.
CHUNK_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the folder that driver and executors share (``spark.checkpoint.dir``); on one machine without
    it, as in tests, under the warehouse. A cluster without it is an error."""
    return scratch_path(spark)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: later reads survive lost executors."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_path(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, but in compressed columnar files: for larger intermediate results."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores after it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without_rows(docs: DataFrame, gone: DataFrame, most: int) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by (doc_id, text_hash), which is broadcast up to ``most`` rows.
    Columns of ``docs`` may have any names."""
    key, digest = free_names(docs, "gone_id", "gone_hash")
    named = settled(gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct())
    return docs.join(F.broadcast(named) if named.count() <= most else named, docs["doc_id"].eqNullSafe(F.col(key)) & (
        F.xxhash64(docs["text"]) == F.col(digest)), "left_anti")


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``, a single longer row alone."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], trim: bool = False):
    """``run``, giving memory that Arrow no longer uses back at its end: the worker lives on for other tasks. With ``trim``
    the C library gives back what it holds as well, which the next task must ask for again."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            give_back = getattr(ctypes.CDLL(None), "malloc_trim", None) if trim else None  # glibc's
            if give_back:
                give_back(0)

    return wrapped


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and how many each text has (null: none)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        mask = full.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(mask)])
        ends = np.cumsum(counts)
        counts = before[ends] - before[ends - counts]
        flat = flat.filter(full)
    return flat, counts


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, every other character as it is."""
    return pc.ascii_lower(texts)


def doc_starts(counts: np.ndarray) -> np.ndarray:
    """Index of each text's first word."""
    return np.cumsum(counts) - counts


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, … of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
