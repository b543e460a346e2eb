"""Language-model scoring with a hidden Markov model over word classes.

Frequent words are classes of their own; the others share classes by their last two letters. A latent state emits a
class, a class emits a word: P(text) = P(classes) x product of P(word | class). Baum-Welch trains the states: each
partition sums expected transitions and emissions over its training texts, Spark adds the sums up, and the small
model goes back to the workers. Scoring runs the scaled forward recursion over the whole text, which is exact.

Word counts cover all training texts and stay on the cluster. Only the counts of the frequent words go to the
workers; what a text has of other words is joined with their counts, and pre-aggregated to a row a text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import crc_mod, doc_starts, lower_ascii, pieces, settled, split_words, stored

#: Words that are classes of their own, classes of the other words, latent states.
HEAD_WORDS, TAIL_CLASSES, STATES = 20_000, 512, 8
#: Texts (about) that start the model off, rounds on them, and passes over all training texts.
START_TEXTS, START_ROUNDS, PASSES = 1_000, 20, 2
#: In training, longer texts count as several sequences of so many tokens. Scores are of whole texts.
STRETCH = 256
#: Tokens worked on at a time in training.
TRAIN_TOKENS = 300_000


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words and their training counts, and of each other class log10 of its tokens + words + 1."""

    place: dict[str, int]
    counts: np.ndarray
    tail_log: np.ndarray
    texts: int
    tokens: int
    words: int

    @property
    def end(self) -> int:
        return len(self.counts)

    @property
    def classes(self) -> int:
        return len(self.counts) + 1 + TAIL_CLASSES


@dataclass(frozen=True)
class Hmm:
    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray  # class by state


def tail_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % TAIL_CLASSES


def _tail_class(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % TAIL_CLASSES).cast("int")


# --- counts ---------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            coded = lower_ascii(split_words(piece.column("text"))[0]).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], ["word", "n"])


def count_words(training: DataFrame, head_words: int = HEAD_WORDS) -> tuple[DataFrame, Vocabulary]:
    """(word, n) of all training texts, and what of it the workers need."""
    counts = stored(
        training.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # The commonest words, as many whole steps of a sixteenth of an octave of counts as stay within ``head_words``.
    step = F.floor(F.log2("n") * 16).cast("int")
    least, so_far = 1 << 30, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # under 1,024
        so_far += r.words
        if so_far > head_words:
            break
        least = r.step
    head = sorted(counts.where(step >= least).collect(), key=lambda r: (-r.n, r.word))
    place = {r.word: k for k, r in enumerate(head)}
    texts = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tail = counts.where(step < least)
    sizes = np.zeros(TAIL_CLASSES)
    for r in tail.groupBy(_tail_class(F.col("word")).alias("c")).agg((F.sum("n") + F.count("*")).alias("s")).collect():
        sizes[r.c] = r.s
    return counts, Vocabulary(
        place, np.array([r.n for r in head], np.int64), np.log10(sizes + 1), texts, total[0] + texts, total[1] + (texts > 0))


class _Reader:
    """Class ids of texts, each with the end after it; the ids of words are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts = split_words(texts)
        coded = lower_ascii(words).dictionary_encode()
        listed = coded.dictionary.to_pylist()
        if len(self.known) > 300_000:
            self.known.clear()
        known, place, end = self.known, self.v.place, self.v.end
        ids = []
        for w in listed:
            c = known.get(w)
            if c is None:
                c = place.get(w)
                c = known[w] = end + 1 + tail_class(w) if c is None else c
            ids.append(c)
        classes = np.array(ids, np.int32)[coded.indices.to_numpy(zero_copy_only=False)] if ids else np.zeros(0, np.int32)
        return np.insert(classes, np.cumsum(counts), end).astype(np.int32), counts + 1


# --- recursions -----------------------------------------------------------------------------------

def log_likelihood(model: Hmm, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence by the scaled forward recursion; every sequence has a token. All run in
    step, the longest first, so that those still going on are always the first ones."""
    order = np.argsort(-counts, kind="stable")
    starts, lengths = doc_starts(counts)[order], counts[order]
    out = np.zeros(len(counts))
    if not len(counts):
        return out
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    alpha = np.tile(model.initial, (len(counts), 1))
    for t in range(int(lengths[0])):
        m = going[t]
        alpha = (alpha[:m] @ model.transition if t else alpha[:m]) * model.emission[classes[starts[:m] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:m] += np.log(scale)
    result = np.zeros(len(counts))
    result[order] = out
    return result


def expected_counts(model: Hmm, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected first states, transitions and emissions of sequences, which run in step."""
    k = len(model.initial)
    first, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emission)
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    size = np.cumsum(lengths)
    cuts = [0, *(np.flatnonzero(np.diff(size // TRAIN_TOKENS)) + 1).tolist(), len(counts)]
    all_starts = doc_starts(counts)[order]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        starts, n = all_starts[a:b], lengths[a:b]
        going = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
        alphas, scales, seen = [], [], []
        alpha = np.tile(model.initial, (b - a, 1))
        for t in range(int(n[0])):
            m = going[t]
            c = classes[starts[:m] + t]
            alpha = (alpha[:m] @ model.transition if t else alpha[:m]) * model.emission[c]
            scale = alpha.sum(1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            scales.append(scale)
            seen.append(c)
        beta = np.ones((b - a, k))
        gammas = [None] * len(alphas)
        for t in range(int(n[0]) - 1, -1, -1):
            m = going[t]
            gammas[t] = alphas[t] * beta[:m]
            if t:
                onward = model.emission[seen[t]] * beta[:m] / scales[t]
                moves += model.transition * (alphas[t - 1][:m].T @ onward)
                back = np.ones((going[t - 1], k))
                back[:m] = onward @ model.transition.T
                beta = back
        first += gammas[0].sum(0)
        flat, weight = np.concatenate(seen), np.concatenate(gammas)
        for s in range(k):
            emitted[:, s] += np.bincount(flat, weights=weight[:, s], minlength=len(emitted))
    return first, moves, emitted


def stretches(counts: np.ndarray, longest: int = STRETCH) -> np.ndarray:
    """Lengths of sequences cut to at most ``longest`` tokens."""
    pieces_of = (counts + longest - 1) // longest
    out = np.full(int(pieces_of.sum()), longest, np.int64)
    out[np.cumsum(pieces_of) - 1] = counts - (pieces_of - 1) * longest
    return out


def normalised(first: np.ndarray, moves: np.ndarray, emitted: np.ndarray, prior: np.ndarray) -> Hmm:
    """The model of expected counts, each state's emissions smoothed by ``prior`` (how often a class occurs at all)."""
    emission = emitted + prior[:, None]
    return Hmm((first + 1) / (first + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emission / emission.sum(0))


def starting_model(classes: np.ndarray, counts: np.ndarray, prior: np.ndarray, states: int, rounds: int) -> Hmm:
    """Baum-Welch on few texts from sticky states that a fixed random draw sets apart."""
    draw = np.random.default_rng(7)
    emission = prior[:, None] * draw.gamma(1.0, 1.0, (len(prior), states))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emission / emission.sum(0))
    cut = stretches(counts)
    for _ in range(rounds):
        model = normalised(*expected_counts(model, classes, cut), prior)
    return model


# --- training and scoring -------------------------------------------------------------------------

def train(training: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES) -> Hmm:
    """A start on about START_TEXTS texts, then ``passes`` rounds of Baum-Welch over all training texts."""
    held = np.full(vocabulary.classes, 0.0)
    held[:vocabulary.end] = vocabulary.counts
    held[vocabulary.end] = vocabulary.texts
    held[vocabulary.end + 1:] = 10 ** vocabulary.tail_log
    prior = 0.5 * (held + 1) / (held + 1).sum()
    share = min(1.0, START_TEXTS / max(vocabulary.texts, 1))
    some = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1e6 * share)) if share < 1 else training

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                classes, counts = reader.read(piece.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([classes.tobytes()]), pa.array([counts.tobytes()])], ["classes", "counts"])

    taken = some.select("text").mapInArrow(read, "classes binary, counts binary").collect()  # about START_TEXTS texts
    sample = sorted((bytes(r.classes), bytes(r.counts)) for r in taken)
    model = starting_model(
        np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(c, np.int32) for c, _ in sample]]),
        np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(n, np.int64) for _, n in sample]]), prior, states, START_ROUNDS)

    names = [f"s{k}" for k in range(states)]
    schema = "row int, " + ", ".join(f"{s} double" for s in names)
    for _ in range(passes):
        def gather(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            reader, total = _Reader(vocabulary), None
            for batch in batches:
                for piece in pieces(batch):
                    classes, counts = reader.read(piece.column("text"))
                    got = expected_counts(model, classes, stretches(counts))
                    total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
            if total is not None:
                first, moves, emitted = total
                table = np.concatenate([emitted, moves, first[None, :]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(table), dtype=np.int32)), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(states)]],
                    ["row", *names])

        sums = training.select("text").mapInArrow(gather, schema).groupBy("row").agg(*[F.sum(s).alias(s) for s in names])
        table = np.zeros((vocabulary.classes + states + 1, states))
        for r in sums.collect():  # a row a class
            table[r.row] = r[1:]
        c = vocabulary.classes
        model = normalised(table[-1], table[c:c + states], table[:c], prior)
    return model


def _tails(vocabulary: Vocabulary):
    """(doc_id, copy, word, n): the words of each text that are not among the frequent ones."""
    place = vocabulary.place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, counts = split_words(piece.column("text"))
                coded = lower_ascii(words).dictionary_encode()
                rare = np.fromiter((w not in place for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
                which = coded.indices.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(rare[which]) if len(which) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)[at]
                width = len(coded.dictionary) + 1
                pair, n = np.unique(owner * width + which[at], return_counts=True)
                took = pa.array(pair // width)
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id").take(took), piece.column("copy").take(took),
                    coded.dictionary.take(pa.array(pair % width)), pa.array(n.astype(np.int64))], ["doc_id", "copy", "word", "n"])

    return run


def _forward(vocabulary: Vocabulary, model: Hmm):
    """(doc_id, copy, n_tokens, n_head, base, score): what the frequent words and the classes contribute."""
    end = vocabulary.end
    head_log = np.concatenate([np.log10(vocabulary.counts + 1.0), [math.log10(vocabulary.texts + 1)], np.zeros(TAIL_CLASSES)])
    class_log = np.concatenate([np.zeros(end + 1), vocabulary.tail_log])
    known = np.concatenate([np.ones(end, np.int64), [int(vocabulary.texts > 0)], np.zeros(TAIL_CLASSES, np.int64)])
    unit = math.log10(vocabulary.tokens + vocabulary.words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(vocabulary)
        for batch in batches:
            for piece in pieces(batch, limit=16 << 20):
                classes, counts = reader.read(piece.column("text"))
                starts = doc_starts(counts)
                score = log_likelihood(model, classes, counts) / math.log(10) - np.add.reduceat(class_log[classes], starts)
                base = np.add.reduceat(head_log[classes], starts) - counts * unit
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("copy"), pa.array(counts), pa.array(np.add.reduceat(known[classes], starts)),
                    pa.array(base), pa.array(score)], ["doc_id", "copy", "n_tokens", "n_head", "base", "score"])

    return run


def language_scores(docs: DataFrame, states: int = STATES, passes: int = PASSES, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text, mod 7, is 2: not learnt from), n_tokens (words and one end), n_known,
    train_tokens, base_score (unigrams, add-one) and score, log10 probabilities of the text, of every row of ``docs``.

    Texts are lower-cased (A-Z); null ones are empty and have the end alone. Rows alike in doc_id and text count once in
    training and get the same scores; a null doc_id counts as the id of empty text. Without any training text every
    probability is even. Other columns are ignored.
    """
    unique = docs.agg(F.count("*") == F.count_distinct("doc_id")).first()[0]
    copy = F.lit(0).cast("long") if unique else F.xxhash64("text")
    rows = docs.select("doc_id", copy.alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows if unique else rows.distinct()
    training = keyed.where(crc_mod("doc_id", 7) != 2)
    counts, vocabulary = count_words(training, head_words)
    model = train(training, vocabulary, states, passes)

    doc, long = keyed.schema["doc_id"], T.LongType()
    tails = keyed.mapInArrow(_tails(vocabulary), T.StructType([
        doc, T.StructField("copy", long), T.StructField("word", T.StringType()), T.StructField("n", long)]))
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)
    per_text = (
        tails.join(counts.withColumnRenamed("n", "c"), "word", "left").groupBy("doc_id", "copy")
        .agg(F.sum(F.col("n") * log).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"))
        .selectExpr("doc_id AS tail_id", "copy AS tail_copy", "tail", "n_tail")
    )
    number = T.DoubleType()
    scored = rows.mapInArrow(_forward(vocabulary, model), T.StructType([
        doc, T.StructField("copy", long), T.StructField("n_tokens", long), T.StructField("n_head", long),
        T.StructField("base", number), T.StructField("score", number)]))
    rest, found = F.coalesce(F.col("tail"), F.lit(0.0)), F.coalesce(F.col("n_tail"), F.lit(0))
    return scored.join(per_text, F.expr("doc_id <=> tail_id AND copy = tail_copy"), "left").select(
        "doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", (F.col("n_head") + found).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + rest).alias("base_score"),
        (F.col("score") + rest).alias("score"))
