"""Quality rules that vote, weighed by what they prove to be worth.

Each rule looks at one statistic of a text and votes good or bad, or abstains between its bounds. How often a rule
votes what on good and on bad texts is estimated by expectation-maximisation, without labels, from the counts of vote
patterns over all texts; a text's posterior probability of being good then replaces the demand that all rules pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import doc_starts, pieces, settled, split_words

REPEAT_WINDOW = 8
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_alnum",
          "n_marks", "n_distinct")


@dataclass(frozen=True)
class Rule:
    """Bad from ``bad`` on, good up to ``good`` (or the other way round where ``bad`` is the lower one)."""

    name: str
    value: Column
    good: float
    bad: float

    def vote(self) -> Column:
        """1 good, -1 bad, 0 abstain; a null value abstains."""
        rising = self.bad > self.good
        is_good = self.value <= self.good if rising else self.value >= self.good
        is_bad = self.value >= self.bad if rising else self.value <= self.bad
        return F.when(is_good, 1).when(is_bad, -1).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", _share("n_symbols", "n_words"), 0.05, 0.2),
        Rule("letters and digits", _share("n_alnum", "word_chars"), 0.93, 0.9),
        Rule("repeated words", _share("n_repeat_words", "n_words"), 0.05, 0.35),
        Rule("repeated lines", _share("n_dup_lines", "n_lines"), 0.1, 0.3),
        Rule("capitals", _share("n_capitals", "n_alnum"), 0.15, 0.5),
        Rule("marks", _share("n_marks", "n_words"), 0.05, 0.3),
        Rule("variety", _share("n_distinct", "n_words"), 0.3, 0.1),
        Rule("mean word", _share("word_chars", "n_words"), 10.0, 20.0),
        Rule("length", F.col("n_words").cast("double"), 40.0, 8.0),
    ]


# --- statistics -----------------------------------------------------------------------------------

def _repeats(ids: np.ndarray, counts: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows of ``size`` (a power of two) words that occur twice or more in that text."""
    total = len(ids)
    out = np.zeros(len(counts), np.int64)
    if total < size:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    # Numbers of windows of 1, 2, 4, … words: equal numbers, equal words. The text is part of the first.
    number = owner.astype(np.int64) * (int(ids.max()) + 1) + ids
    width = 1
    while width < size:
        _, number = np.unique(number, return_inverse=True)
        pair = number[:-width].astype(np.int64) * (int(number.max()) + 1) + number[width:]
        number, width = pair, 2 * width
    whole = owner[:total - size + 1] == owner[size - 1:]
    at = np.flatnonzero(whole)
    _, number, times = np.unique(number[at], return_inverse=True, return_counts=True)
    again = at[times[number] > 1]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    covered = np.cumsum(change[:total]) > 0
    np.add.at(out, owner[covered], 1)
    return out


def _counted(texts: pa.Array, chars: str) -> np.ndarray:
    return pc.count_substring_regex(texts, chars).to_numpy(zero_copy_only=False).astype(np.int64)


def describe_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = doc_starts(counts)
    lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(owner * (len(coded.dictionary) + 1) + ids)
    duplicate, lines = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    split = pc.split_pattern(texts, "\n")
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat):
        full = pc.match_substring_regex(flat, r"[^ \t\n\x0b\x0c\r]").to_numpy(zero_copy_only=False)
        line_ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
        line_owner = np.repeat(np.arange(len(sizes)), sizes)[full]
        np.add.at(lines, line_owner, 1)
        distinct = np.unique(line_owner * (int(line_ids.max(initial=0)) + 1) + line_ids)
        kinds = np.bincount(distinct // (int(line_ids.max(initial=0)) + 1), minlength=len(counts))
        duplicate = lines - kinds
    return {
        "n_words": counts, "word_chars": lengths[starts + counts] - lengths[starts],
        "n_symbols": _counted(texts, r"[#*$%&|<>]"), "n_dup_lines": duplicate, "n_repeat_words": _repeats(ids, counts),
        "n_lines": lines, "n_capitals": _counted(texts, r"\p{Lu}"), "n_alnum": _counted(texts, r"[\p{L}\p{N}]"),
        "n_marks": _counted(texts, r"!"), "n_distinct": np.bincount(pairs // (len(coded.dictionary) + 1), minlength=len(counts)),
    }


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text; null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                stats = describe_texts(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *[pa.array(stats[c], pa.int64()) for c in _LONGS]], ["doc_id", *_LONGS])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in _LONGS]]))


# --- the label model ------------------------------------------------------------------------------

@dataclass(frozen=True)
class RuleModel:
    """``good[c][j]``: how often rule j votes good when it votes on texts of class c, of share ``shares[c]``. Class 0 are
    the good texts, the others kinds of bad ones."""

    shares: tuple[float, ...]
    good: tuple[tuple[float, ...], ...]
    accuracies: tuple[float, ...]


def _kinds(bad: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Groups of rules that mostly vote bad together, two at least in each: the kinds of bad text to begin with. What
    one rule alone objects to is no kind, but that rule's noise."""
    together = (bad * n[:, None]).T @ bad
    alone = np.diag(together)
    either = alone[:, None] + alone[None, :] - together
    near = together > 0.5 * either
    groups: list[set[int]] = []
    for j in range(bad.shape[1]):
        mates = {j} | {int(i) for i in np.flatnonzero(near[j])}
        for g in [g for g in groups if g & mates]:
            mates |= g
            groups.remove(g)
        groups.append(mates)
    return sorted(sorted(g) for g in groups if len(g) > 1) or [list(range(bad.shape[1]))]


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> RuleModel:
    """Expectation-maximisation over (votes, how many texts vote so): one class of good texts, and one for each kind of
    bad text that several rules object to together. A rule that abstains says nothing. Rules are taken to be no
    worse than chance: a good vote is never evidence of a bad text. No texts leave even shares."""
    votes = np.array([p for p, _ in patterns], np.int64).reshape(-1, rules)
    n = np.array([c for _, c in patterns], float)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    kinds = _kinds(down, n)
    r = np.stack([down[:, g].mean(1) for g in kinds], 1)
    r = np.concatenate([np.maximum(1 - r.max(1, keepdims=True, initial=0), 0.02), r], 1)
    r /= r.sum(1, keepdims=True)
    shares = good = None
    for _ in range(rounds):
        mass = r * n[:, None]
        shares = (mass.sum(0) + 1) / (n.sum() + r.shape[1])
        good = (mass.T @ up + 1) / (mass.T @ (up + down) + 2)
        good[1:] = np.minimum(good[1:], good[0])
        z = np.log(shares) + up @ np.log(good).T + down @ np.log(1 - good).T
        z = np.exp(z - z.max(1, keepdims=True))
        new = z / z.sum(1, keepdims=True)
        moved = np.abs(new - r).max(initial=0)
        r = new
        if moved < 1e-6:
            break
    bad = shares[1:] @ (1 - good[1:])
    return RuleModel(tuple(map(float, shares)), tuple(tuple(map(float, g)) for g in good), tuple(map(float, shares[0] * good[0] + bad)))


def vote_and_weigh(stats: DataFrame, rules: list[Rule]) -> tuple[DataFrame, RuleModel]:
    """``stats`` with ``votes`` and ``quality``, the posterior probability of a good text, and the model. The counts of
    vote patterns, at most 3 to the number of rules, are all that leaves the cluster."""
    voted = stats.withColumn("votes", F.array(*[r.vote() for r in rules]))
    counts = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    model = fit_rules(sorted((tuple(r.votes), r.n) for r in counts), len(rules))

    def likelihood(c: int) -> Column:
        terms = [F.element_at(F.array(F.lit(math.log(1 - g)), F.lit(0.0), F.lit(math.log(g))), F.get("votes", F.lit(j)) + 2)
                 for j, g in enumerate(model.good[c])]
        return reduce(lambda a, b: a + b, terms, F.lit(math.log(model.shares[c])))

    each = voted.withColumn("_l", F.array(*[likelihood(c) for c in range(len(model.shares))]))
    top = F.array_max("_l")
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_l")))
    return each.withColumn("quality", F.exp(F.get("_l", F.lit(0)) - top) / total).drop("_l"), model


def judge_quality(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, ``base_failed`` (fewer than 20 words, or more than 30 % in repeated windows), ``votes``,
    ``quality`` and ``kept`` (not failed, and quality at least ``threshold``) of every row of ``docs``.

    Null and empty texts have no words and fail. Repeated and null doc_id are judged row by row; other columns are
    ignored; an empty table gives no rows.
    """
    stats = settled(describe(docs))
    judged, _ = vote_and_weigh(stats, rules or default_rules())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
