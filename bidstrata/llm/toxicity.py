"""Toxicity by weak supervision.

Words and word beginnings that mark toxic texts are mined from a bounded sample of labelled rows and dealt to lexicon
voters by kind and strength; pattern voters look at shouting, exclamation marks, symbols and repetition. Each voter
votes toxic or clean or abstains. A generative label model estimates by expectation-maximisation how often each voter
votes what in either class, and how voters correlate within a class: evidence that several voters share counts once.
The posteriors of these voters are the training labels of a linear classifier on the mined terms, which scores every
text. Labels mine the lexica and anchor the model: while rates and correlations are estimated, they name the classes. In
the posteriors they have no vote.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import crc_mod, doc_starts, pieces, releasing, split_words, stored

#: About how many labelled rows the model is fitted on at most, and how many mined terms it may use.
FIT_ROWS, MAX_TERMS = 20_000, 4_096
THRESHOLD = 0.3
_EDGES = re.compile(r"^\W+|\W+$")
_BEGINNINGS = (3, 4, 5, 6)
#: Odd factors that turn one hash into several.
_SKETCH_FACTORS = np.array([2 * k * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(1, 5)], np.uint64)


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds of each term's presence, and of a text with none of them."""

    weights: dict[str, float]
    bias: float
    voters: tuple[str, ...] = ()
    accuracies: tuple[float, ...] = ()


def terms_of(word: str) -> list[str]:
    """The terms one word gives: itself ("w:…") and its beginnings ("4:…"), lower-cased, outer punctuation off."""
    bare = _EDGES.sub("", word.lower())
    if not bare:
        return []
    return [f"w:{bare}", *[f"{n}:{bare[:n]}" for n in _BEGINNINGS if len(bare) >= n]]


# --- the sample -----------------------------------------------------------------------------------

def labelled_sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y) of rows that may teach: those whose crc32(doc_id as text) mod 4 is not 2, thinned by a hash of
    doc_id to about ``fit_rows``. Null labels are left out; of repeated labels the highest counts."""
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    )
    total = usable.count()
    if total <= fit_rows:
        return usable
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * fit_rows / total))


def _patterns(text: str, words: list[str]) -> list[int]:
    """Votes of the pattern voters: 1 toxic, -1 clean, 0 abstain."""
    letters = sum(map(str.isalpha, text)) or 1
    capital = sum(map(str.isupper, text)) / letters
    marks, size = text.count("!"), max(len(words), 1)
    symbols = sum(text.count(c) for c in "#*$%&@")
    variety = len(set(words)) / size
    return [
        1 if capital > 0.3 else -1 if capital < 0.1 else 0,
        1 if marks > 0.05 * size else -1 if not marks else 0,
        1 if symbols > 0.05 * size else -1 if not symbols else 0,
        1 if size > 20 and variety < 0.2 else -1 if variety > 0.4 else 0,
        1 if size <= 3 else 0,
    ]


PATTERN_VOTERS = ("capitals", "exclamation", "symbols", "repetition", "brevity")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, sketch, terms, patterns) of each text. Near copies mostly share the sketch, the least of word pairs by each of
    several hashes; texts that have a passage in common, no more, do not."""
    for batch in batches:
        for piece in pieces(batch, limit=1 << 20):
            terms, sketches, votes = [], [], []
            for text in piece.column("text").to_pylist():
                words = [w.decode() for w in text.encode().split()]
                terms.append(sorted({t for w in set(words) for t in terms_of(w)}))
                pairs = zip(words, words[1:], strict=False) if len(words) > 1 else [words]
                h = np.fromiter((xxhash.xxh64_intdigest(" ".join(p)) for p in pairs), np.uint64)
                least = [int((h * factor).min()) for factor in _SKETCH_FACTORS]
                sketches.append(xxhash.xxh64_intdigest(repr(least)) >> 1)
                votes.append(_patterns(text, words))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("y"), pa.array(sketches, pa.int64()), pa.array(terms, pa.list_(pa.string())),
                 pa.array(votes, pa.list_(pa.int32()))], ["doc_id", "y", "sketch", "terms", "patterns"])


def _g2(a, n, toxic, total):
    """Likelihood ratio of a term in ``a`` of its ``n`` texts toxic, where ``toxic`` of ``total`` are; 0 if it is not
    over-represented."""
    def part(k, e):
        return k * math.log(k / e) if k else 0.0

    if not 0 < toxic < total or a / n <= toxic / total:
        return 0.0
    p, b = toxic / total, n - a
    c, d = toxic - a, (total - toxic) - b
    return 2 * (part(a, n * p) + part(b, n * (1 - p)) + part(c, (total - n) * p) + part(d, (total - n) * (1 - p)))


# --- the label model ------------------------------------------------------------------------------

def fit_label_model(
    votes: np.ndarray, anchor: int, rounds: int = 25, anchor_votes: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior probability of class 1 for each row of ``votes`` (-1, 0 or 1), the voters' accuracies where they
    vote, and their within-class correlations. ``anchor`` is a column known to be good, which names the classes while rates
    and correlations are estimated. Without ``anchor_votes`` the posterior is of the other columns' votes alone."""
    n, voters = votes.shape
    y = np.clip((votes[:, anchor] + 1) / 2, 0.02, 0.98)
    weight = np.ones(voters)
    rho = np.zeros((voters, voters))
    for _ in range(rounds):
        prior = (y.sum() + 1) / (n + 2)
        llr = np.zeros((n, voters))
        for v in (-1, 0, 1):
            hit = votes == v
            one = (y @ hit + 0.5) / (y.sum() + 1.5)
            none = ((1 - y) @ hit + 0.5) / (n - y.sum() + 1.5)
            llr += hit * np.log(one / none)
        center = votes - np.outer(y, (y @ votes) / max(y.sum(), 1e-9)) - np.outer(1 - y, ((1 - y) @ votes) / max(n - y.sum(), 1e-9))
        scale = np.sqrt((center ** 2).sum(0)) + 1e-9
        rho = np.clip((center.T @ center) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + rho.sum(1))
        weight[anchor] = 1
        new = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + llr @ weight, -30, 30)))
        moved = np.abs(new - y).max()
        y = new
        if moved < 1e-4:
            break
    rest = (np.arange(voters) != anchor) | anchor_votes
    y = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + llr[:, rest] @ weight[rest], -30, 30)))
    cast = votes != 0
    right = (cast & (votes > 0)) * y[:, None] + (cast & (votes < 0)) * (1 - y[:, None])
    return y, right.sum(0) / np.maximum(cast.sum(0), 1), rho


def _fit_linear(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, width: int, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on the presence of terms (``rows``, ``terms``: where), by Nesterov steps."""
    w, b = np.zeros(width), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    # A diagonal bound on the curvature: a row's terms per column.
    per_row = np.bincount(rows, minlength=len(y)) + 1.0
    curve = np.bincount(terms, weights=per_row[rows], minlength=width) / 4 + l2
    curve_b = per_row.sum() / 4
    vw, vb = w.copy(), b
    for step in range(600):
        z = np.bincount(rows, weights=vw[terms], minlength=len(y)) + vb
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new_w = vw - (np.bincount(terms, weights=r[rows], minlength=width) + l2 * vw) / curve
        new_b = vb - r.sum() / curve_b
        pace = step / (step + 3)
        vw, vb = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Fit on a sample of labelled rows; what comes to the driver is bounded by ``fit_rows`` and ``max_terms``.

    Where there are no labels, or of one class only, the model is their smoothed share alone.
    """
    sample = labelled_sample(labels, fit_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")  # about fit_rows rows
    schema = T.StructType([
        chosen.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("sketch", T.LongType()),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("patterns", T.ArrayType(T.IntegerType()))])
    seen = stored(chosen.mapInArrow(releasing(_described), schema).withColumn("row", F.monotonically_increasing_id()))
    firsts = seen.groupBy("sketch", "y").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("least.row")
    apart = seen.join(F.broadcast(firsts), "row", "left_semi").select("y", "terms")  # about fit_rows numbers at most
    sizes = apart.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    total, toxic = sizes[0], sizes[1]
    if not 0 < toxic < total:
        return ToxicityModel({}, math.log((toxic + 0.1) / (total - toxic + 0.9)))
    counts = apart.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("y").alias("a"))
    # In order of how much more often than by chance; ties by name.
    often = counts.where(F.col("a") * total > F.col("n") * toxic).where("a >= 2")
    gain = F.col("a") * F.log(F.col("a") * total / (F.col("n") * toxic)) + F.when(
        F.col("n") > F.col("a"), (F.col("n") - F.col("a")) * F.log((F.col("n") - F.col("a")) * total / (F.col("n") * (total - toxic)))
    ).otherwise(0.0)
    best = [(r.term, r.a, r.n) for r in often.orderBy(gain.desc(), "term").limit(max_terms).collect()]
    floor = 2 * math.log(2 * max(often.count(), 50))  # a chance find among so many is unlikely above
    best = [(t, a, n) for t, a, n in best if _g2(a, n, toxic, total) >= floor]
    place = {t: k for k, (t, _, _) in enumerate(best)}
    lookup = docs.sparkSession.createDataFrame(list(place.items()), "term string, k int")
    marked = (
        seen.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(lookup), "term")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    )
    found = seen.join(marked, "doc_id", "left").select("doc_id", "y", "patterns", "ks")
    rows = sorted(found.toLocalIterator(), key=lambda r: str(r.doc_id))  # at most about fit_rows

    # Lexicon voters: kind of term by strength; and one voter a kind that votes clean where none of its terms occurs.
    kinds = sorted({t[0] for t in place})
    tier = [(t[0], 0 if a / n >= 0.97 else 1 if a / n >= 0.8 else 2) for t, a, n in best]
    lexica = sorted(set(tier))
    names = ["labels", *[f"{k}/{s}" for k, s in lexica], *[f"no {k}" for k in kinds], *PATTERN_VOTERS]
    votes = np.zeros((len(rows), len(names)), np.int8)
    for i, r in enumerate(rows):
        ks = r.ks or []
        votes[i, 0] = 1 if r.y else -1
        got = {tier[k] for k in ks}
        for j, lex in enumerate(lexica, 1):
            votes[i, j] = lex in got
        had = {k for k, _ in got}
        for j, kind in enumerate(kinds, 1 + len(lexica)):
            votes[i, j] = 0 if kind in had else -1
        votes[i, -len(PATTERN_VOTERS):] = r.patterns
    y, accuracies, _ = fit_label_model(votes.astype(float), anchor=0, anchor_votes=False)
    where = np.repeat(np.arange(len(rows)), [len(r.ks or []) for r in rows])
    which = np.array([k for r in rows for k in (r.ks or [])], np.int64)
    w, b = _fit_linear(where, which, y, len(best))
    return ToxicityModel({t: float(w[k]) for t, k in place.items()}, float(b), tuple(names), tuple(map(float, accuracies)))


# --- scoring --------------------------------------------------------------------------------------

def score_texts(texts: pa.Array, model: ToxicityModel, known: dict[str, list[str]]) -> np.ndarray:
    """Probability of each text. ``known`` remembers the weighted terms of words across calls."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    if len(known) > 50_000:
        known.clear()
    hits: list[list[str]] = []
    for word in vocabulary:
        hit = known.get(word)
        if hit is None:
            hit = [t for t in terms_of(word) if t in model.weights]
            if len(word) <= 64:
                known[word] = hit
        hits.append(hit)
    telling = np.fromiter(map(bool, hits), bool, len(hits))
    which = coded.indices.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(telling[which]) if len(which) else np.zeros(0, np.int64)
    owner = np.searchsorted(doc_starts(counts) + counts, at, side="right")
    z = np.full(len(counts), model.bias)
    present: dict[int, set[str]] = {}
    for doc, word in zip(owner.tolist(), which[at].tolist(), strict=True):
        present.setdefault(doc, set()).update(hits[word])
    for doc, terms in present.items():
        z[doc] += sum(model.weights[t] for t in sorted(terms))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic in a new last column ``name`` (it must be new).

    Null and empty texts have no terms and get the model's base probability.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            for piece in pieces(batch, limit=1 << 20):
                score = score_texts(piece.column("text"), model, known)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score)], [*piece.schema.names, name])

    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    return docs.mapInArrow(releasing(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out (not learnt from, whatever its label), score and predicted (1 from a score of 0.3).

    Every row of ``docs`` gives one, repeated or null doc_id too; labels of unknown documents are ignored. Other
    columns, whatever their names, are never inputs.
    """
    model = fit_toxicity(docs, labels, fit_rows)
    return with_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
