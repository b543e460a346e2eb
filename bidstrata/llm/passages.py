"""Substring dedup by repeated-phrase automata.

A window is 20 consecutive words of a text. A window is repeated if the same word sequence starts earlier: in a text of
smaller doc_id, or before it in the same text; the words it covers are removed.

Anchors find what may recur: every window holds one six-word phrase of least hash, and equal windows hold the same one,
so a window whose anchor phrase occurs once in the corpus occurs once. Texts whose anchors recur are read again; the
stretches of windows around those anchors (segments, at most 34 words) are aggregated to distinct ones with their
first occurrence, map side first, so a passage that a third of all texts share is one row. All windows of a segment
that occurred before are repeated. The distinct segments go to the shard of their anchor, where whole windows are
counted, which confirms the passages that recur; these are compiled with pyahocorasick into automata of bounded size, and
the shard's segments stream through them to locate every occurrence. No text passes through an automaton that cannot
match it, so work stays in proportion to the texts. An anchor with very many distinct segments would fill a shard; its
windows are aggregated to first occurrences and joined back instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import CHUNK_BYTES, doc_starts, pieces, split_words, spread, stored

WINDOW, PHRASE = 20, 6
#: Distinct segments from which an anchor's windows are treated one by one, and rows a worker locates in together.
HOT_ANCHOR, GROUP_ROWS = 200_000, 10_000
#: Characters there are, and the one for words that occur once.
LETTERS, _BREAK = 0x110000 - 0x800, "\0"
#: Patterns in one automaton at most; a shard with more compiles several, one after the other.
AUTOMATON_PATTERNS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same on every machine."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter(map(digest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def anchors(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``counts`` words with hashes ``h``: each stretch of windows that share an anchor, as (text, first
    window, number of windows, hash of the anchor phrase, whether the phrase comes again soon, without which no two
    windows of the stretch can be equal)."""
    width = len(h) - WINDOW + 1
    if width <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(len(h) - PHRASE + 1, np.uint64)
    for k in range(PHRASE):
        g = g * _MIX + h[k:len(h) - PHRASE + 1 + k]
    # The low four bits tell the 15 phrases of a window apart; which of equal phrases is taken does not matter.
    g = (_scramble(g) & ~np.uint64(15)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(15))
    span, reach = WINDOW - PHRASE + 1, 1
    least = g
    while 2 * reach <= span:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[:width], least[span - reach:span - reach + width])
    starts = doc_starts(counts)
    owner = np.repeat(np.arange(len(counts)), counts)[:width]
    where = np.flatnonzero(np.arange(width) + WINDOW <= (starts + counts)[owner])
    least = least[where]
    anchor = where + ((least.astype(np.int64) - where) & 15)
    new = np.ones(len(where), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(where) != 1)
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate([first, [len(where)]]))
    begin = where[first]
    phrase, at = g >> np.uint64(4), anchor[first]
    again = np.zeros(len(first), bool)
    for k in range(1, span):
        again |= phrase[np.minimum(at + k, len(phrase) - 1)] == np.where(at + k < len(phrase), phrase[at], ~phrase[at])
    return owner[begin], begin - starts[owner[begin]], run, phrase[at], again


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words, counts = split_words(piece.column("text"))
            text, _, _, h, again = anchors(word_hashes(words), counts)
            twice = 1 + again  # a stretch may hold equal windows itself
            text, h = np.repeat(text, twice), np.repeat(h, twice)
            took = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(took), piece.column("copy").take(took), pa.array(h.view(np.int64))],
                ["doc_id", "copy", "anchor"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which halves what their shuffles write."""
    squeeze = zstandard.ZstdCompressor(level=5).compress
    for batch in batches:
        for piece in pieces(batch):
            packed = [squeeze(t.encode()) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("copy"), pa.array(packed, pa.binary())], ["doc_id", "copy", "packed"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Pieces of a batch of packed texts, with their words and how many each has."""
    expand = zstandard.ZstdDecompressor().decompress
    for piece in pieces(batch, "packed", CHUNK_BYTES // 2):
        texts = pa.array([expand(p).decode() for p in piece.column("packed").to_pylist()], pa.string())
        yield piece, *split_words(texts)


def _listed(owner: np.ndarray, value: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which (owner, value) are in the list of their owner; rarely one that is not, which later steps bear."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    of, item = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False)

    def key(o, v):
        return _scramble(v.astype(np.uint64) + o.astype(np.uint64) * _MIX)

    return np.isin(key(owner, value), key(of, item))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of the texts around their recurring anchors."""
    for batch in batches:
        for piece, words, counts in _unpacked(batch):
            text, begin, run, h, _ = anchors(word_hashes(words), counts)
            keep = np.flatnonzero(_listed(text, h.view(np.int64), piece.column("wanted")))
            text, begin, run, h = text[keep], begin[keep], run[keep], h[keep].view(np.int64)
            length = run + WINDOW - 1
            ends = np.cumsum(length)
            index = spread(doc_starts(counts)[text] + begin, length)
            segment = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), words.take(pa.array(index))), " ")
            took = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id").take(took), piece.column("copy").take(took), pa.array(begin), pa.array(run), pa.array(h),
                segment,
            ], ["doc_id", "copy", "start", "windows", "anchor", "segment"])


def _letters(segments: list[list[str]]) -> list[str] | None:
    """Each segment as a string with a character for a word, all from one alphabet; None if that is too small. Only words
    that occur again need a character of their own: no window with another one recurs, and ``_BREAK`` stands for those."""
    seen: set[str] = set()
    code: dict[str, str] = {}
    for words in segments:
        for w in words:
            if w in seen and w not in code:
                n = len(code) + 1
                if n >= LETTERS:
                    return None
                code[w] = chr(n if n < 0xD800 else n + 0x800)
            seen.add(w)
    return ["".join([code.get(w, _BREAK) for w in words]) for words in segments]


def _locate(segments: list[str]) -> list[tuple[int, int, int]]:
    """Runs of repeated windows in distinct segments, sorted by first occurrence: (which, first window, windows).

    Words become single characters of one alphabet, windows strings of 20. What occurs twice is compiled, with its
    first occurrence, and the segments stream through the automaton. Should more words recur than there are characters,
    the windows are looked up as they are, without an automaton.
    """
    split = [s.split(" ") for s in segments]
    strings = _letters(split)
    covered: dict[int, set[int]] = {}
    if strings is None:
        known: dict[str, int] = {}
        for row, words in enumerate(split):
            for k in range(len(words) - WINDOW + 1):
                if known.setdefault(" ".join(words[k:k + WINDOW]), 64 * row + k) != 64 * row + k:
                    covered.setdefault(row, set()).add(k)
        return _runs(covered)
    first: dict[str, int] = {}
    recurring: dict[str, int] = {}
    for row, s in enumerate(strings):
        for k in range(len(s) - WINDOW + 1):
            window = s[k:k + WINDOW]
            if _BREAK in window:
                continue
            place = 64 * row + k
            seen = first.setdefault(window, place)
            if seen != place:
                recurring[window] = seen
    patterns = list(recurring.items())
    for at in range(0, len(patterns), AUTOMATON_PATTERNS):
        automaton = ahocorasick.Automaton()
        for window, seen in patterns[at:at + AUTOMATON_PATTERNS]:
            automaton.add_word(window, seen)
        automaton.make_automaton()
        for row, s in enumerate(strings):
            for end, seen in automaton.iter(s):
                if seen != 64 * row + end - WINDOW + 1:
                    covered.setdefault(row, set()).add(end - WINDOW + 1)
    return _runs(covered)


def _runs(covered: dict[int, set[int]]) -> list[tuple[int, int, int]]:
    out = []
    for row, places in covered.items():
        places = sorted(places)
        breaks = [k for k in range(1, len(places)) if places[k] != places[k - 1] + 1]
        out += [(row, places[a], b - a) for a, b in zip([0, *breaks], [*breaks, len(places)], strict=True)]
    return out


def _hit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Locate within groups of one anchor, sorted by (anchor, doc_id, copy, start); small groups are done together."""
    def found(rows: list[tuple]) -> pa.RecordBatch:
        hits = _locate([segment for *_, segment in rows])
        columns = list(zip(*[(*rows[r][:2], rows[r][2] + k, n) for r, k, n in hits], strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], doc_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "copy", "start", "windows"])

    rows: list[tuple] = []
    last = None
    doc_type = None
    for batch in batches:
        doc_type = batch.column("doc_id").type
        names = ("doc_id", "copy", "start", "segment")
        for anchor, *row in zip(*[batch.column(c).to_pylist() for c in ("anchor", *names)], strict=True):
            if anchor != last and len(rows) >= GROUP_ROWS:
                yield found(rows)
                rows = []
            last = anchor
            rows.append(tuple(row))
    if rows:
        yield found(rows)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, start, windows): runs of repeated windows of ``docs`` (doc_id, copy, text)."""
    doc = docs.schema["doc_id"]
    long = T.LongType()
    rows = stored(docs.mapInArrow(_anchor_rows, T.StructType([
        doc, T.StructField("copy", long), T.StructField("anchor", long)])))
    recurring = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = rows.join(recurring, "anchor").groupBy("doc_id", "copy").agg(  # no more than a text has words
        F.collect_list("anchor").alias("wanted")).selectExpr("doc_id AS want_id", "copy AS want_copy", "wanted")
    packed = docs.mapInArrow(_pack, T.StructType([doc, T.StructField("copy", long), T.StructField("packed", T.BinaryType())]))
    texts = packed.join(wanted, F.expr("doc_id <=> want_id AND copy = want_copy")).select("doc_id", "copy", "packed", "wanted")
    segments = stored(texts.mapInArrow(_segment_rows, T.StructType([
        doc, *[T.StructField(c, long) for c in ("copy", "start", "windows", "anchor")], T.StructField("segment", T.StringType())
    ])).withColumn("segment_hash", F.xxhash64("segment")))

    # Distinct segments with their first occurrences; anchor and hash, 124 bits, stand for the words.
    place = F.struct("doc_id", "copy", "start")
    distinct = stored(segments.groupBy("anchor", "segment_hash").agg(
        F.min(place).alias("first"), F.min("segment").alias("segment")).select("anchor", "segment_hash", "first.*", "segment"))
    firsts = distinct.selectExpr("anchor", "segment_hash", "struct(doc_id, copy, start) AS first")
    copies = segments.select("anchor", "segment_hash", "windows", place.alias("place")).join(
        firsts, ["anchor", "segment_hash"]).where(~F.col("place").eqNullSafe(F.col("first"))).select("place.*", "windows")

    hits = T.StructType([doc, *[T.StructField(c, long) for c in ("copy", "start", "windows")]])
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("segments"))
    hot = sizes.where(f"segments > {HOT_ANCHOR}").select("anchor")
    any_hot = not hot.isEmpty()
    cold = distinct.join(hot, "anchor", "left_anti") if any_hot else distinct
    located = cold.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "copy", "start").mapInArrow(_hit_rows, hits)
    found = copies.union(located)
    if not any_hot:
        return found
    words = F.split("segment", " ")
    windows = distinct.join(hot, "anchor").select("doc_id", "copy", "start", words.alias("ws")).select(
        "doc_id", "copy", "start", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - WINDOW)).alias("k")).select(
        "doc_id", "copy", (F.col("start") + F.col("k")).alias("start"),
        F.array_join(F.slice("ws", F.col("k") + 1, WINDOW), " ").alias("window"))
    earliest = windows.groupBy("window").agg(F.min(place).alias("first"))
    return found.union(windows.join(earliest, "window").where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "copy", "start", F.lit(1).cast("long").alias("windows")))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, words, counts in _unpacked(batch):
            runs = piece.column("runs")
            sizes = pc.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False)
            flat = runs.flatten()
            begin = np.repeat(doc_starts(counts), sizes) + flat.field("start").to_numpy(zero_copy_only=False)
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + flat.field("windows").to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
            stay = np.cumsum(gone[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(counts)])]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(pa.array(stay))), " ")
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), pa.array(counts), pa.array(counts - np.diff(ends)), kept,
            ], ["doc_id", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, the words left joined by single spaces, of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows are judged on the input, not on what is left. Null and empty texts
    have no words. Rows that share a doc_id are ordered by a hash of their text; those that share the text as well
    count as one document and are treated alike. A null doc_id comes before all others. Other columns are ignored.
    """
    unique = docs.agg(F.count("*") == F.count_distinct("doc_id")).first()[0]
    copy = F.lit(0).cast("long") if unique else F.xxhash64("text")
    keyed = docs.select("doc_id", copy.alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    doc = keyed.schema["doc_id"]
    runs = repeated_runs(keyed.distinct() if not unique else keyed).groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("start", "windows")).alias("runs")).selectExpr("doc_id AS run_id", "copy AS run_copy", "runs")
    packed = keyed.mapInArrow(_pack, T.StructType([doc, T.StructField("copy", T.LongType()), T.StructField("packed", T.BinaryType())]))
    joined = packed.join(runs, F.expr("doc_id <=> run_id AND copy = run_copy"), "left").select("doc_id", "packed", "runs")
    return joined.mapInArrow(_kept, T.StructType([
        doc, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]))
