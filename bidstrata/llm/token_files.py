"""Token-ID output: Parquet files of token lists with chosen encoding, row groups and page sizes.

A file row is one document: its metadata columns, ``shard`` (the file's place in the order), ``offset`` (ids of the
same shard before it), ``n_tokens`` and ``tokens`` (list of int32, the end id included). Rows ascend by ``doc_id``
over all shards and within each. Parquet's writer puts page indexes into every file, so that a read of a few documents
or of the metadata columns alone touches only their pages.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import doc_starts, lower_ascii, pieces, releasing, shared_folder, split_words, spread

#: Words whose ids a worker remembers (twice as many at most), and the longest remembered.
CACHE_WORDS, CACHE_LENGTH = 300_000, 64
#: Text encoded at a time.
PIECE_BYTES = 2 << 20
_BAR = "|"
#: Marks at a word's end that are tokens of their own after a letter.
_TAIL = ".,!?;:%$*&#"


class WordEncoder:
    """Ids of words, as int32 bytes, remembered from task to task of one Python worker.

    New words are encoded in one string with bars between them, which costs far less than a call a word; words that
    hold a bar, or a special token's string, go one by one; marks after a word's last letter go apart. The memory has two generations: a full one becomes the
    old one, and what is still in use moves over.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bar = self.tokenizer.encode(_BAR, add_special_tokens=False).ids
        self.odd = re.compile("|".join(map(re.escape, [
            _BAR, *[t.content for t in self.tokenizer.get_added_tokens_decoder().values()]])))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.int32).tobytes()

    def _together(self, words: list[str]) -> list[bytes]:
        texts = [f" {_BAR} ".join(words[at:at + 500]) for at in range(0, len(words), 500)]
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            some = words[len(out):len(out) + 500]
            ids = np.array(e.ids, np.int32)
            bars = np.flatnonzero(ids == self.bar[0]).tolist() if len(self.bar) == 1 else []
            if len(bars) != len(some) - 1:  # a tokenizer for which bars don't do
                out += [self._alone(w) for w in some]
                continue
            raw = ids.tobytes()
            out += [raw[4 * a:4 * b] for a, b in zip([0, *[x + 1 for x in bars]], [*bars, len(ids)], strict=True)]
        return out

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._alone(tail)
        return self.tails[tail]

    def encode(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        stems, ids, fresh = [], [], {}
        for w in words:
            stem = w.rstrip(_TAIL)
            if not stem or not stem[-1].isalpha() or not stem[-1].lower()[-1].isalpha():  # İ ends in a mark lower-cased
                stem = w
            got = young.get(stem)
            if got is None and stem not in fresh:
                got = old.get(stem)
                if got is None and self.odd.search(stem):
                    got = self._alone(stem)
                if got is None:
                    fresh[stem] = b""
                elif len(stem) <= CACHE_LENGTH:
                    young[stem] = got
            stems.append(stem)
            ids.append(got)
        if fresh:
            fresh.update(zip(fresh, self._together(list(fresh)), strict=True))
            ids = [fresh[stem] if got is None else got for stem, got in zip(stems, ids, strict=True)]
            young.update((stem, got) for stem, got in fresh.items() if len(stem) <= CACHE_LENGTH)
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return [got if len(stem) == len(w) else got + self._tail(w[len(stem):]) for w, stem, got in zip(words, stems, ids, strict=True)]


def encode_texts(texts: pa.Array, encoder: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id after it, and where each text ends."""
    words, counts = split_words(texts)
    coded = lower_ascii(words).dictionary_encode()
    each = encoder.encode(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
    ids = np.frombuffer(b"".join(each), np.int32)
    which = coded.indices.to_numpy(zero_copy_only=False)
    per_word = lengths[which]
    flat = ids[spread((np.cumsum(lengths) - lengths)[which], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(counts)]
    flat = np.insert(flat, ends, np.int32(end_id)).astype(np.int32)
    return flat, ends + np.arange(1, len(ends) + 1)


def _encode(path: str, end_id: int, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        shard, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, limit=piece_bytes):
                flat, ends = encode_texts(piece.column("text"), encoder, end_id)
                n = np.diff(np.concatenate([[0], ends]))
                names = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([
                    *[piece.column(c) for c in names], pa.array(np.full(len(n), shard, np.int32)),
                    pa.array(offset + doc_starts(n)), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                ], [*names, "shard", "offset", "n_tokens", "tokens"])
                offset += int(n.sum())

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, metadata: Sequence[str] = (),
    encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10,
    page_rows: int = 2_000, compression: str = "zstd", piece_bytes: int = PIECE_BYTES,
    thrifty: bool = False,
) -> None:
    """Encode ``text`` and write it in ascending ``doc_id`` order.

    ``tokenizer_path`` is read on every executor. Words are encoded apart and lower-cased (A-Z), and their ids are
    remembered; this equals encoding the text for tokenizers that lower-case, split at white space and drop it.
    ``piece_bytes``: text encoded at a time; smaller pieces take less memory and more time. ``thrifty``: workers give freed
    memory back after each task, which takes time too.
    ``encoding``: "dictionary", or "delta" (binary packed differences). ``metadata``: columns to keep; where one
    is called shard, offset, n_tokens or tokens, it is left out in favour of the file's own.

    A null text is empty and yields the end id alone. Repeated ``doc_id`` are all written, ordered by text; null
    ids come first. An empty table gives files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    own = {"shard", "offset", "n_tokens", "tokens", "doc_id", "text"}
    keep = [c for c in metadata if c not in own]
    placed = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[f"`{c}`" for c in keep])
        .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    )
    fields = [f for f in placed.schema.fields if f.name != "text"]
    schema = T.StructType([
        *fields, T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ])
    (
        placed.mapInArrow(releasing(_encode(tokenizer_path, end_id, piece_bytes), trim=thrifty), schema).write.mode("overwrite")
        .option("compression", compression).option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: ids of all documents before. Select columns and filter on ``doc_id`` for
    selective reads; both reach the scan."""
    rows = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row per file
        rows.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
        .select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    )
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("_before") + F.col("offset")).drop("_before")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        offsets = lists.offsets.to_numpy().tolist()
        raw = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        names = [c for c in batch.schema.names if c != "tokens"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    rows = tokens.select("doc_id", "start", "n_tokens", "tokens")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(_crc, schema)


def write_and_digest(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Write the files into the shared folder and report on what they hold."""
    path = shared_folder(docs.sparkSession)
    write_tokens(docs, path, tokenizer_path, end_id, **options)
    return token_digests(read_tokens(docs.sparkSession, path))
