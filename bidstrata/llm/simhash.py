"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one 32-bit half. Each half is covered
by the words of a covering code: the perfect Hamming code on 31 bits (covering radius 1) with the last bit free. A
fingerprint has its home at the nearest anchor (within 1) and is replicated to every anchor within radius plus
threshold (2), so a pair with near halves meets at the home of either: at most 17 anchors a half. Within an anchor,
homes are compared with all, and only a spanning forest of the links found is kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import doc_starts, lower_ascii, pieces, releasing, settled, split_words, without_rows
from bidstrata.llm.components import least_reachable

THRESHOLD = 3
#: Text fingerprinted at a time; every word of it is hashed in a few shingles, which takes many times its size.
PIECE_BYTES = 1 << 20
#: Rows to remove are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: An anchor with more homes than this (or than a 100,000th of all) is split further; see ``_split_hot``.
HOT_HOMES, MAX_HOT = 4_096, 100_000


# --- fingerprints ---------------------------------------------------------------------------------

def _bit_counts(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each group's hashes have each of the 64 bits set; every group has a hash.

    Eight one-byte counters share a 64-bit word, and blocks of at most 255 hashes keep them from overflowing.
    """
    blocks = (counts + 254) // 255
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_starts = starts[owner] + 255 * nth
    first_block = np.cumsum(blocks) - blocks
    out = np.zeros((len(counts), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), block_starts)
        by_byte = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, :, bit] = np.add.reduceat(by_byte, first_block, axis=0)
    return out.reshape(len(counts), 64)


def fingerprint_texts(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Unsigned fingerprints. Empty and null texts: 0."""
    words, counts = split_words(lower_ascii(texts.fill_null("")))
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    offsets = np.concatenate([[0], np.cumsum(n)])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")
    raw = joined.buffers()[2].to_pybytes()
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    gaps = np.ones(len(lengths), np.int64)
    gaps[offsets[1:] - 1] = 0  # a space after every word but the text's last
    ends = np.cumsum(lengths + gaps) - gaps
    begins = ends - lengths
    made = np.maximum(n - shingle + 1, 1)
    firsts = doc_starts(made)
    owner = np.repeat(np.arange(len(n)), made)
    first_word = offsets[owner] + np.arange(len(owner)) - firsts[owner]
    last_word = np.minimum(first_word + shingle - 1, offsets[owner + 1] - 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(raw[a:b], 42) for a, b in zip(begins[first_word].tolist(), ends[last_word].tolist(), strict=True)),
        np.uint64, len(owner))
    majority = 2 * _bit_counts(h, firsts, made) > made[:, None]
    out[full] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, and what tells rows of one doc_id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                fp = fingerprint_texts(piece.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    long = T.LongType()
    return rows.mapInArrow(releasing(run), T.StructType([rows.schema["doc_id"], T.StructField("text_hash", long), T.StructField("fp", long)]))


# --- anchors --------------------------------------------------------------------------------------

_PLACES = np.arange(1, 32, dtype=np.uint32)
#: For each syndrome s, the 15 pairs of places whose exclusive or is s, as bit masks.
_PAIR_MASKS = np.array([
    [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a ^ s > a] if s else [0] * 15 for s in range(32)
], np.uint32)


def _syndromes(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.uint32)
    for place in _PLACES:
        s ^= np.where((x >> (place - np.uint32(1))) & np.uint32(1), place, np.uint32(0))
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 32-bit words: the home anchor, and (row, anchor) of every other anchor within distance 2."""
    top, low = half & np.uint32(1 << 31), half & np.uint32((1 << 31) - 1)
    s = _syndromes(low)
    nearest = low ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    rows, found = [np.arange(len(half))], [nearest | (top ^ np.uint32(1 << 31))]
    off = np.flatnonzero(s)
    rows.append(np.repeat(off, 15))
    found.append((low[off][:, None] ^ _PAIR_MASKS[s[off]]).ravel() | np.repeat(top[off], 15))
    return nearest | top, np.concatenate(rows), np.concatenate(found)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fp = batch.column("fp").slice(at, 20_000).to_numpy()
            for side in (0, 1):
                half = (fp.view(np.uint64) >> np.uint64(32 * side)).astype(np.uint32)
                home, rows, others = anchors(half)
                keys = np.concatenate([home, others]).astype(np.int64) | (side << 32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), pa.array(np.concatenate([fp, fp[rows]])),
                    pa.array(np.arange(len(keys)) >= len(fp)),
                ], ["anchor", "fp", "guest"])


def _compress(label: np.ndarray) -> np.ndarray:
    while True:
        shorter = label[label]
        if np.array_equal(shorter, label):
            return label
        label = shorter


def _compare(keys: np.ndarray, fp: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within equal keys (sorted, homes first)."""
    n = len(fp)
    bits = fp.view(np.uint64)
    label = np.arange(n)
    left, step = np.flatnonzero(~guest), 1
    while True:
        left = left[left + step < n]
        left = left[np.all(keys[:, left] == keys[:, left + step], axis=0)]
        if not len(left):
            break
        hit = left[np.bitwise_count(bits[left] ^ bits[left + step]) <= THRESHOLD]
        other = hit + step
        while True:
            a, b = label[hit], label[other]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            label = _compress(label)
        step += 1
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare rows sorted by (anchor, part); the last anchor of a batch waits for the rest of its rows."""
    def found(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table.column(c).to_numpy() for c in ("anchor", "part")])
        a, b = _compare(keys, table.column("fp").to_numpy(), table.column("guest").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("anchor", "part")])
        same = np.all(keys == keys[:, -1:], axis=0)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield found(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        elif waiting and any(waiting[-1].column(c)[-1] != batch.column(c)[0] for c in ("anchor", "part")):
            yield found(pa.Table.from_batches(waiting))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield found(pa.Table.from_batches(waiting))


def _split_hot(replicas: DataFrame, fingerprints: int) -> DataFrame:
    """Anchors with very many homes are compared in parts: fingerprints within 3 bits agree in one of the four bytes of
    the other half (and in that of this half), so all go into four parts by (byte, value) and no link is lost. The
    list of such anchors is bounded: each has a 100,000th of the homes at least."""
    homes = replicas.where("NOT guest").groupBy("anchor").agg(F.count("*").alias("homes"))
    hot = homes.where(f"homes > {max(HOT_HOMES, 2 * fingerprints // MAX_HOT)}").select(F.col("anchor").alias("hot"))
    other = F.when(F.col("anchor") < (1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = F.array(*[F.lit(1 + 256 * k) + F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) for k in range(4)])
    return (
        replicas.join(F.broadcast(hot), F.col("anchor") == F.col("hot"), "left")
        .withColumn("part", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)))
        .drop("hot")
    )


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints within THRESHOLD bits, thinned to what keeps components whole."""
    schema = T.StructType([
        T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("guest", T.BooleanType())])
    replicas = _split_hot(fps.select("fp").mapInArrow(_replicate, schema), fps.count())
    ordered = replicas.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "guest", "fp")
    links = ordered.mapInArrow(_links, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    return links.distinct()


def _classes(rows: DataFrame, **least) -> DataFrame:
    """(fp, root, *least): each distinct fingerprint's component, and aggregates of ``rows`` over the component, each
    given as a function of the column to take the least of."""
    classes = settled(rows.groupBy("fp").agg(*[F.min(c).alias(n) for n, c in least.items()]))  # equal ones meet here
    roots = least_reachable(fingerprint_links(classes))
    placed = classes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    over = placed.groupBy("root").agg(*[F.min(n).alias(n) for n in least])
    return placed.select("fp", "root").join(over, "root")


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id linked directly or through others.

    Texts are lower-cased (A-Z) and cut into ``shingle``-word shingles, repeats counted; fewer words make one shingle;
    no words (empty or null text) make fingerprint zero. Repeated doc_id give a row each; a null doc_id is never
    the least one unless its component has no other. An empty table gives no rows. Other columns are ignored.
    """
    rows = settled(fingerprints(docs, shingle))
    named = _classes(rows, component_id=F.col("doc_id"))
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_name() -> Column:
    """What rows of a component are ordered by: doc_id, null ones last, then the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null ones last), then of the least hash of its
    text. Rows alike in doc_id and text are copies, of which one stays. All columns are kept."""
    rows = settled(fingerprints(docs, shingle))
    return keep_first(docs, rows, _classes(rows, first=row_name()), "fp")


def keep_first(docs: DataFrame, rows: DataFrame, firsts: DataFrame, of: str) -> DataFrame:
    """``docs`` without the ``rows`` (doc_id, text_hash, ``of``) that are not the first of ``firsts`` (``of``, first)."""
    left = without_rows(docs, rows.join(firsts, of).where(~row_name().eqNullSafe(F.col("first"))), BROADCAST_ROWS)
    copies = rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if copies else left
