"""Quality grades by ordinal regression.

A cumulative-link model: P(grade <= k) = logistic(threshold_k - w·x), with one weight vector for all grades and
ordered thresholds. x are shares of a text's words: by the hash of the word, of its shape (capitals, digits, the marks at
its end) and of its last letters, and of the text by its length and variety. A text's expected grade ranks it, its
tail probability P(grade >= k) selects.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import crc_mod, doc_starts, pieces, split_words

#: Rated texts the model is fitted on (about, at most), and hash buckets of features.
FIT_ROWS, BUCKETS = 4_000, 1 << 16
_MARKS = string.punctuation


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray


def _hash(kind: str, value: str, buckets: int) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % buckets


def word_features(word: str, buckets: int = BUCKETS) -> tuple[int, int, int]:
    bare = word.rstrip(_MARKS)
    shape = f"{word[len(bare):]}|{bare.isupper()}|{bare.istitle()}|{any(map(str.isdigit, bare))}|{not bare}"
    return _hash("word", word.lower(), buckets), _hash("shape", shape, buckets), _hash("end", bare[-3:].lower(), buckets)


def _text_features(counts: np.ndarray, distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Two buckets a text: its length in powers of two, and its variety in tenths."""
    length = [_hash("length", str(int(n).bit_length()), buckets) for n in counts]
    variety = [_hash("variety", str(int(10 * d / n)) if n else "none", buckets) for n, d in zip(counts, distinct, strict=True)]
    return np.array([length, variety], np.int64).reshape(2, -1).T


class _Features:
    """Buckets of words, remembered from piece to piece."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, texts: pa.Array):
        """Per piece: buckets of the distinct words, which word stands where, words per text, buckets of the texts."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        if len(self.known) > 200_000:
            self.known.clear()
        listed = []
        for w in coded.dictionary.to_pylist():
            got = self.known.get(w)
            if got is None:
                got = word_features(w, self.buckets)
                if len(w) <= 64:
                    self.known[w] = got
            listed.append(got)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(listed) + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        distinct = np.bincount(np.unique(owner * width + which) // width, minlength=len(counts))
        return np.array(listed, np.int64).reshape(-1, 3), which, counts, owner, _text_features(counts, distinct, self.buckets)


def _sparse(features: _Features, texts: pa.Array):
    """Each text's (buckets, shares)."""
    listed, which, counts, owner, whole = features.of(texts)
    spread = (owner[:, None] * features.buckets + listed[which]).ravel()
    pair, n = np.unique(spread, return_counts=True)
    text, bucket = pair // features.buckets, pair % features.buckets
    share = n / np.maximum(counts, 1)[text]
    ends = np.searchsorted(text, np.arange(len(counts) + 1))
    for k in range(len(counts)):
        a, b = ends[k], ends[k + 1]
        yield np.concatenate([bucket[a:b], whole[k]]), np.concatenate([share[a:b], [1.0, 1.0]])


def fit_thresholds_and_weights(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, levels: int, width: int,
                               l2: float = 0.02, steps: int = 200) -> OrdinalModel:
    """Maximum likelihood with ridge penalty by accelerated gradient steps. Thresholds stay ordered, as the first and
    the logarithms of the gaps after it are what is fitted."""
    n = len(grades)
    at_most = np.array([(grades <= k).sum() + 1 for k in range(levels - 1)]) / (n + levels)
    theta = np.log(at_most / (1 - at_most))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(levels - 1))
    p = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    w = np.zeros(width)
    mass = np.bincount(rows, weights=values, minlength=n)
    # A row's shares and its two thresholds bound the curvature of each coordinate.
    curve = np.bincount(columns, weights=values * (mass[rows] + 2), minlength=width) / 2 + l2
    step_p = 2.0 / max((mass + 2).sum(), 1)
    best, momentum = -np.inf, 0

    def logistic(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    vw, vp = w.copy(), p.copy()
    for step in range(steps):
        th = np.cumsum(np.concatenate([vp[:1], np.exp(vp[1:])]))
        eta = np.bincount(rows, weights=values * vw[columns], minlength=n)
        edges = np.concatenate([[-np.inf], th, [np.inf]])
        hi, lo = logistic(edges[grades + 1] - eta), logistic(edges[grades] - eta)
        hi, lo = np.where(grades == levels - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
        prob = np.maximum(hi - lo, 1e-9)
        d_eta = hi + lo - 1  # of the log-likelihood
        d_hi, d_lo = hi * (1 - hi) / prob, -lo * (1 - lo) / prob
        d_th = np.array([d_hi[grades == k].sum() + d_lo[grades == k + 1].sum() for k in range(levels - 1)])
        tail = np.cumsum(d_th[::-1])[::-1]
        d_p = np.concatenate([tail[:1], tail[1:] * np.exp(vp[1:])])
        new_w = vw + (np.bincount(columns, weights=values * d_eta[rows], minlength=width) - l2 * vw) / curve
        new_p = vp + step_p * d_p
        value = np.log(prob).sum() - l2 / 2 * (vw @ vw)
        momentum = 1 if value < best else momentum + 1  # restart where it overshoots
        best = value
        pace = (momentum - 1) / (momentum + 2)
        vw, vp = new_w + pace * (new_w - w), new_p + pace * (new_p - p)
        w, p = new_w, new_p
    return OrdinalModel(w, np.cumsum(np.concatenate([p[:1], np.exp(p[1:])])))


def fit_ordinal(docs: DataFrame, ratings: DataFrame, levels: int, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> OrdinalModel:
    """Fit on ``ratings`` (doc_id, grade from 0 to levels - 1), thinned by a hash of doc_id to about ``fit_rows``, which
    bounds what comes to the driver. Rows lacking either are left out; of several grades the least counts. Without any
    ratings all grades are as likely."""
    usable = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    total = usable.count()
    if total > fit_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * fit_rows / total))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(buckets)
        for batch in batches:
            for piece in pieces(batch, limit=1 << 20):
                made = list(_sparse(features, piece.column("text")))
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("grade"),
                    pa.array([c.astype(np.int32).tobytes() for c, _ in made], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())], ["doc_id", "grade", "columns", "values"])

    got = chosen.mapInArrow(run, T.StructType([
        chosen.schema["doc_id"], T.StructField("grade", T.IntegerType()), T.StructField("columns", T.BinaryType()),
        T.StructField("values", T.BinaryType())])).toLocalIterator()
    table = sorted((str(r.doc_id), r.grade, bytes(r.columns), bytes(r["values"])) for r in got)
    columns = [np.frombuffer(c, np.int32) for _, _, c, _ in table]
    rows = np.repeat(np.arange(len(table)), [len(c) for c in columns])
    values = np.concatenate([np.zeros(0), *[np.frombuffer(v, np.float32) for *_, v in table]])
    grades = np.array([g for _, g, _, _ in table], np.int64)
    return fit_thresholds_and_weights(rows, np.concatenate([np.zeros(0, np.int32), *columns]).astype(np.int64), values, grades, levels, buckets)


def score_grades(docs: DataFrame, model: OrdinalModel, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, expected_grade and tails (P(grade >= 1), P(grade >= 2), …) of every row. Null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(buckets)
        for batch in batches:
            for piece in pieces(batch):
                listed, which, counts, _, whole = features.of(piece.column("text"))
                each = np.concatenate([[0.0], np.cumsum(model.weights[listed].sum(1)[which])]) if len(which) else np.zeros(1)
                starts = doc_starts(counts)
                eta = (each[starts + counts] - each[starts]) / np.maximum(counts, 1) + model.weights[whole].sum(1)
                tails = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - eta[:, None], -40, 40)))
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(tails.sum(1)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * tails.shape[1]), pa.array(tails.ravel())),
                ], ["doc_id", "expected_grade", "tails"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, T.StructType([
        rows.schema["doc_id"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]))


def grade_quality(docs: DataFrame, ratings: DataFrame, levels: int, *, select_from: int = 1, threshold: float = 0.5,
                  fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text, mod 4, is 2: not learnt from), expected_grade, tails and ``kept``: the
    grade is ``select_from`` or more with probability ``threshold`` at least.

    Every row of ``docs`` gives one, repeated and null doc_id too; other columns are ignored.
    """
    model = fit_ordinal(docs, ratings.where(crc_mod("doc_id", 4) != 2), levels, fit_rows)
    return score_grades(docs, model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "expected_grade", "tails",
        (F.get("tails", F.lit(select_from - 1)) >= threshold).alias("kept"))


def graded_labels(labels: DataFrame, columns: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """Grades from two marks: 0 for poor texts, 1 for good but toxic ones, 2 for good clean ones."""
    quality, toxic = (F.col(c) for c in columns)
    return labels.select("doc_id", F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2).alias("grade"))
