"""Importance resampling toward a target distribution, over hashed n-grams named by CRC.

A document, its words joined by one space, is scanned once and the running CRC at every word's end is kept. The CRC of
any n-gram follows from two of them: CRC is linear over GF(2), so ``crc(AB) = shift(crc(A), |B|) xor crc(B)``, where
``shift`` runs a register through ``|B|`` zero bytes, and the prefix cancels. No n-gram is ever built as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import CHUNK_BYTES, pieces, releasing, stored
from bidstrata.llm.infilling import digest_numbers
from bidstrata.sources.sinks import with_row_index

#: Words of one document that are hashed at a time; bounds memory whatever the length of a text.
BLOCK_WORDS = 200_000
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: N-grams of fewer bytes than this are shifted in one step, by a table for their length.
SHORT = 64
#: Separators become spaces: every ASCII character but digits and lower-case letters, of text already lower-cased.
_SPACED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


# --- CRC arithmetic -------------------------------------------------------------------------------

def _by_bytes(columns: np.ndarray) -> np.ndarray:
    """The 32 images of single bits, as four tables of the images of bytes."""
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        byte, value = divmod(bit, 8)
        tables[byte] ^= np.where(np.arange(256) >> value & 1, columns[bit], np.uint32(0)).astype(np.uint32)
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ tables[byte][(x >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


@cache
def _byte_step() -> np.ndarray:
    """What a register's low byte turns into when a zero byte is read."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


def _read(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs after one more byte."""
    state = ~crc
    return ~(_byte_step()[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8)))


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the shifts by 0 … SHORT-1 bytes, and by 1, 2, 4, … 2^31 bytes."""
    step = _byte_step()
    columns = [np.uint32(1 << b) for b in range(32)]
    short = np.empty((SHORT, 4, 256), np.uint32)
    state = np.array(columns, np.uint32)
    for n in range(SHORT):
        short[n] = _by_bytes(state)
        state = step[state & np.uint32(255)] ^ (state >> np.uint32(8))
    powers = [short[1]]
    for _ in range(31):
        powers.append(_by_bytes(_apply(powers[-1], _apply(powers[-1], np.array(columns, np.uint32)))))
    return short, powers


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs run through ``n_bytes`` zero bytes each, without the usual complement before and after."""
    short, powers = _shifts()
    out = np.empty(len(crc), np.uint32)
    few = n_bytes < SHORT
    x, n = crc[few], n_bytes[few]
    part = short[n, 0, x & np.uint32(255)]
    for byte in (1, 2, 3):
        part ^= short[n, byte, (x >> np.uint32(8 * byte)) & np.uint32(255)]
    out[few] = part
    x, n = crc[~few], n_bytes[~few]
    for bit in range(32 if len(n) else 0):
        on = (n >> bit & 1).astype(bool)
        x[on] = _apply(powers[bit], x[on])
    out[~few] = x
    return out


# --- features -------------------------------------------------------------------------------------

def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded number at a time."""
    at, size = 0, 8 * BLOCK_WORDS
    while at < len(text):
        end = at + size
        while end < len(text) and _SPACED[text[end] | (0x20 if 0x41 <= text[end] <= 0x5A else 0)] != 0x20:
            end += 1  # never within a word
        words = text[at:end].lower().translate(_SPACED).split()
        for k in range(0, len(words), BLOCK_WORDS):
            yield words[k:k + BLOCK_WORDS]
        at = end


def feature_crcs(text: bytes, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """CRCs of all runs of 1 … ``longest`` consecutive words of a text, joined by one space, and the number of words,
    block by block."""
    running, place, begun = 0, 0, False
    # Of each word: the CRC before it (of all that precedes it, the space included) and after it, and where it lies.
    known = np.zeros((4, 0), np.int64)
    for words in _blocks(text):
        if not words:
            continue
        first = zlib.crc32(b" ", running) if begun else running
        after = np.fromiter(
            accumulate(words[1:], lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc)), initial=zlib.crc32(words[0], first)),
            np.uint32, len(words))
        before = np.concatenate([np.array([first], np.uint32), _read(after[:-1], 0x20)])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = place + np.cumsum(lengths + 1) - 1
        old = known.shape[1]  # words of the block before, which n-grams across the edge begin with
        known = np.concatenate([known, np.stack([before, after, stops - lengths, stops])], axis=1)
        crc_before, crc_after = known[:2].astype(np.uint32)
        starts, stops = known[2:]
        found = []
        for n in range(1, longest + 1):
            last = np.arange(max(old, n - 1), known.shape[1])
            begin = last - n + 1
            found.append(crc_after[last] ^ shift(crc_before[begin], stops[last] - starts[begin]))
        yield np.concatenate(found), len(words)
        running, begun, place = int(after[-1]), True, int(stops[-1]) + 1
        known = known[:, max(known.shape[1] - longest + 1, 0):]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for piece in pieces(batch, limit=CHUNK_BYTES):
            yield piece, pc.cast(piece.column("text"), pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a row for each bucket that has any. Every task adds its own up first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches):
            for text in texts:
                for crcs, _ in feature_crcs(text or b"", longest):
                    counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(releasing(run), "bucket bigint, n bigint")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """How much likelier each bucket is in ``target`` than in ``docs``: floor(1000 ln) of the ratio of its add-one shares.

    The driver gets ``buckets`` numbers, a parameter, whatever the size of the tables. Empty tables have no features, and
    shares of one in ``buckets``.
    """
    found = []
    for df in (docs, target):
        counts = np.zeros(buckets)
        for r in bucket_counts(df, buckets, longest).collect():
            counts[r["bucket"]] = r["n"]
        found.append(counts)
    own, aim = found
    return np.floor(1000 * np.log(
        (aim + 1) * (own.sum() + buckets) / ((own + 1) * (aim.sum() + buckets)))).astype(np.int64)


def feature_weights(docs: DataFrame, gains: np.ndarray, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of every row's features, floored; 0 where there are none."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches):
            out = np.zeros((3, len(texts)), np.int64)
            for k, text in enumerate(texts):
                total = 0
                for crcs, words in feature_crcs(text or b"", longest):
                    out[0, k] += words
                    out[1, k] += len(crcs)
                    total += int(gains[crcs % np.uint32(buckets)].sum())
                out[2, k] = total // int(out[1, k]) if out[1, k] else 0
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", "text")
    long = T.LongType()
    return rows.mapInArrow(releasing(run), T.StructType([
        rows.schema["doc_id"], *[T.StructField(n, long) for n in ("n_words", "n_features", "weight")]]))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000,
    longest: int = 2,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: drawn rows are ranked 1, 2, 3, … by score.

    The score is the weight plus Gumbel noise by the hash of ``seed`` and doc_id, so the greatest scores are a draw without
    replacement in proportion to exp(weight / 1000). ``percent`` of the rows with ``least_words`` words or more are drawn
    (rounded down), ties to the smaller doc_id, null last. Null and empty texts have no features, weight 0 and no rank.
    Repeated rows are drawn apart and have ranks of their own. Empty ``docs`` give no rows; an empty ``target`` prefers rare
    features. Further columns are ignored.

    Ranks come from offsets of range partitions, not from one task. The scored rows are numbers only; they and the ranked
    ones are written to the shared folder.
    """
    gains = bucket_gains(docs, target, buckets, longest)
    (h,) = digest_numbers(F.col("doc_id"), seed, 1)
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(feature_weights(docs, gains, longest).withColumn("score", F.col("weight") + noise))
    fit = scored.where(F.col("n_words") >= least_words)
    n_drawn = fit.count() * percent // 100
    # The last column spreads rows that tie on everything else, such as repeated ones, over partitions.
    placed = fit.withColumns({
        "_first": -F.col("score"), "_unnamed": F.col("doc_id").isNull(), "_nth": F.monotonically_increasing_id()})
    ranked = with_row_index(placed, ["_first", "_unnamed", "doc_id", "_nth"], "_place").withColumn(
        "rank", F.when(F.col("_place") < n_drawn, F.col("_place") + 1))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(
        scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")).select(columns))
