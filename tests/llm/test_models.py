"""Learnt operators: against plain computations, held-out accuracy, and exact properties of their models."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidstrata.llm import hmm, mixing, ordinal, toxicity
from tests.llm.conftest import ODD, crc, low, words

NONE = "doc_id long, text string"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toxic_corpus(n=400, seed=1):
    """English marks toxic texts by words, other texts by how words begin, as endings vary."""
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = [f"{draw.choice('bcdfglmnprst')}{draw.choice('aeiou')}{draw.choice(['n', 'r', 'st', 'l'])}{draw.choice('aeiou')}" for _ in range(draw.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(draw.randint(0, len(w)), draw.choice(["Vilewort!", "zorgon", "qwexy" + draw.choice("abcdefgh") + draw.choice("xyz")]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_texts_not_learnt_from(spark, documents):
    rows, labels = toxic_corpus()
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), labelled(spark, labels)).collect()}
    assert len(got) == len(rows)
    for i, _, bad in labels:
        assert got[i].held_out == (crc(i, 4) == 2) and got[i].predicted == (got[i].score >= 0.3)
    held = [(got[i].predicted, bad) for i, _, bad in labels if got[i].held_out]
    assert sum(p == b for p, b in held) / len(held) > 0.97


def test_held_out_labels_teach_nothing(spark, documents):
    rows, labels = toxic_corpus()
    turned = [(i, q, 1 - t if crc(i, 4) == 2 else t) for i, q, t in labels]
    a, b = (sorted(map(tuple, toxicity.toxicity(documents(rows), labelled(spark, x)).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows(spark, documents):
    none = labelled(spark, [])
    got = toxicity.toxicity(documents(ODD), none).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.3 for r in got)
    mixed = [(0, 1, 1), (0, 1, 1), (4, 1, 0), (7, 1, None), (None, 1, 1), (99, 1, 1)]
    assert toxicity.toxicity(documents(ODD), labelled(spark, mixed)).count() == len(ODD)
    assert toxicity.toxicity(documents([]), none).count() == 0
    with pytest.raises(ValueError, match="already"):
        toxicity.with_toxicity(documents(ODD), toxicity.ToxicityModel({}, 0.0), "lang")


def test_label_model_discounts_copies_of_a_voter():
    draw = np.random.default_rng(1)
    y = draw.random(3000) < 0.3
    def voter(accuracy):
        return np.where(draw.random(3000) < accuracy, y, ~y) * 2 - 1
    anchor, good, weak = voter(0.95), voter(0.9), voter(0.7)
    votes = np.stack([anchor, good, weak, weak, weak, weak], 1).astype(float)
    posterior, accuracies, rho = toxicity.fit_label_model(votes, 0)
    assert rho[2, 3] > 0.9 and rho[1, 2] < 0.2
    assert ((posterior > 0.5) == y).mean() > 0.94
    assert accuracies[1] > accuracies[2]


# --- mixing ------------------------------------------------------------------------------------------

def language_rows(n=120):
    draw, rows, labels = random.Random(3), [], []
    for i in range(n):
        kind = "a" if i % 4 else "b"
        text = " ".join(f"{kind}{draw.randint(0, 20)}" for _ in range(draw.randint(1, 60)))
        rows.append((i, text if i % 10 else text + " " + " ".join(f"a{k} b{k}" for k in range(10))))
        labels.append((i, kind))
    return rows, labels


def test_rates_off_the_bounds_are_the_nearest_that_meet_the_targets(spark, documents):
    """Against the dense least-norm solution of the normal equations."""
    rows, labels = language_rows()
    domains = spark.createDataFrame(labels, "doc_id long, domain string")
    first, names = mixing.mixing_rates(documents(rows), domains, {"a": 1.0, "b": 1.0})
    amount = {r.doc_id: r.n_words * np.array(r.posteriors) for r in first.collect()}
    have = sum(amount.values())
    weights = 0.95 * have / have.sum() + 0.05 / len(names)
    got = {r.doc_id: r.rate for r in mixing.mixing_rates(documents(rows), domains, dict(zip(names, map(float, weights), strict=True)))[0].collect()}
    a = np.stack([amount[i] for i in sorted(amount)], axis=1)
    nearest = 1 + a.T @ np.linalg.solve(a @ a.T, weights * have.sum() - a.sum(1))
    assert (nearest > 0).all() and np.allclose([got[i] for i in sorted(got)], nearest, atol=1e-6)


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_rates_meet_targets(spark, documents, floor):
    rows, labels = language_rows()
    domain = spark.createDataFrame(labels[:60], "doc_id long, domain string")
    rates, names = mixing.mixing_rates(documents(rows), domain, {"a": 1.0, "b": 1.0, "c": 5.0}, floor=floor)
    got = rates.collect()
    assert names == ("a", "b") and len(got) == len(rows) and min(r.rate for r in got) >= floor
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 for r in got)
    sums = [sum(r.rate * r.n_words * r.posteriors[k] for r in got) for k in (0, 1)]
    assert abs(sums[0] / sums[1] - 1) < 1e-3
    top = [names[int(np.argmax(r.posteriors))] for r in sorted(got, key=lambda r: r.doc_id)]
    assert np.mean([t == k for t, (_, k) in zip(top, labels, strict=True)]) > 0.9
    used = mixing.apply_rates(documents(rows), rates)
    assert len(used.columns) == 7
    times = Counter(r.doc_id for r in used.collect())
    assert all(math.floor(r.rate) <= times[r.doc_id] <= math.ceil(r.rate) for r in got)
    assert floor == 0 or len(times) == len(rows)


def test_more_domains_than_one_row_of_sums_holds(spark, documents):
    n = 66
    rows = [(k, " ".join([f"own{k % n}x{k % 3}"] * 20 + ["shared"] * 5)) for k in range(3 * n)]
    domain = spark.createDataFrame([(k, f"d{k % n:02}") for k, _ in rows], "doc_id long, domain string")
    weights = {f"d{k:02}": 1.0 + (k % 2) for k in range(n)}
    rates, names = mixing.mixing_rates(documents(rows), domain, weights)
    got = rates.collect()
    assert len(names) == n and len(got) == len(rows)
    sums = np.array([sum(r.rate * r.n_words * r.posteriors[k] for r in got) for k in range(n)])
    assert np.allclose(sums / sums.sum(), np.array([weights[d] for d in names]) / sum(weights.values()), atol=1e-4)
    with pytest.raises(ValueError, match="max_domains"):
        mixing.mixing_rates(documents(rows), domain, weights, max_domains=n - 1)


def test_both_ways_to_sum_agree(spark, documents, monkeypatch):
    rows = [(k, f"one two three w{k % 4} w{k % 4} v{k % 7}") for k in range(40)]
    domain = spark.createDataFrame([(k, "abcd"[k % 4]) for k, _ in rows], "doc_id long, domain string")
    weights = {"a": 4.0, "b": 1.0, "c": 2.0, "d": 1.0}
    few = {r.doc_id: r.rate for r in mixing.mixing_rates(documents(rows), domain, weights)[0].collect()}
    monkeypatch.setattr(mixing, "FEW_DOMAINS", 0)
    many = {r.doc_id: r.rate for r in mixing.mixing_rates(documents(rows), domain, weights)[0].collect()}
    assert many.keys() == few.keys() and all(abs(many[k] - few[k]) < 1e-6 for k in few)


def test_rates_of_odd_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, domain string")
    plain, names = mixing.mixing_rates(documents(ODD), none, {"en": 1.0})
    assert names == () and {r.rate for r in plain.collect()} == {1.0}
    assert mixing.apply_rates(documents(ODD), plain).count() == len(ODD)
    some = spark.createDataFrame([(0, "en"), (5, "de"), (None, "x"), (4, None)], "doc_id long, domain string")
    rates, _ = mixing.mixing_rates(documents(ODD), some, {"en": 0.5, "de": 0.5}, floor=1.0)
    assert rates.count() == len(set(ODD)) and rates.where("rate < 1 OR rate IS NULL").count() == 0
    assert mixing.mixing_rates(documents([]), some, {"en": 1.0})[0].count() == 0


# --- hidden Markov model --------------------------------------------------------------------------------

def plain_forward(model, sequence):
    total = 0.0
    for states in itertools.product(range(len(model.initial)), repeat=len(sequence)):
        p = model.initial[states[0]] * model.emission[sequence[0], states[0]]
        for a, b, c in zip(states, states[1:], sequence[1:], strict=False):
            p *= model.transition[a, b] * model.emission[c, b]
        total += p
    return math.log(total)


def random_model(states=3, classes=5):
    draw = np.random.default_rng(2)
    transition, emission = draw.random((states, states)), draw.random((classes, states))
    first = draw.random(states)
    return hmm.Hmm(first / first.sum(), transition / transition.sum(1, keepdims=True), emission / emission.sum(0))


def test_forward_is_the_sum_over_all_paths():
    model, sequences = random_model(), [[0, 1, 2, 3, 4], [4], [2, 2], [1, 0, 3, 3, 2, 1, 0]]
    got = hmm.log_likelihood(model, np.concatenate(sequences), np.array([len(s) for s in sequences]))
    assert np.allclose(got, [plain_forward(model, s) for s in sequences])


def test_expected_counts_are_posteriors():
    model, sequence = random_model(), [0, 3, 3, 1]
    first, moves, emitted = hmm.expected_counts(model, np.array(sequence * 2), np.array([4, 4]))
    assert np.isclose(first.sum(), 2) and np.isclose(moves.sum(), 6) and np.allclose(emitted.sum(1), [2, 2, 0, 4, 0])
    total, expected = 0.0, np.zeros((3, 3))
    for states in itertools.product(range(3), repeat=4):
        p = model.initial[states[0]] * np.prod([model.emission[c, s] for c, s in zip(sequence, states, strict=True)])
        p *= np.prod([model.transition[a, b] for a, b in itertools.pairwise(states)])
        total += p
        for a, b in itertools.pairwise(states):
            expected[a, b] += 2 * p
    assert np.allclose(moves, expected / total)


def test_training_never_lowers_the_likelihood():
    draw = np.random.default_rng(4)
    counts = draw.integers(1, 30, 50)
    classes = draw.integers(0, 5, counts.sum())
    model, last = random_model(), -np.inf
    for _ in range(6):
        now = hmm.log_likelihood(model, classes, counts).sum()
        assert now > last
        last = now
        model = hmm.normalised(*hmm.expected_counts(model, classes, counts), np.full(5, 1e-6))


def test_stretches():
    assert hmm.stretches(np.array([1, 256, 257, 600])).tolist() == [1, 256, 256, 1, 256, 256, 88]


@pytest.mark.parametrize("head", [3, 1000])
def test_language_scores(documents, head):
    rows = [*ODD, *[(20 + i, " ".join(("a b" if i % 2 else "x y").split() * (3 + i % 5)) + f" Rare{i % 7} only{i}") for i in range(60)]]
    got = hmm.language_scores(documents(rows), states=3, head_words=head).collect()
    tokens = [[*words(low(t)), None] for _, t in rows]
    seen = {(i, t or "") for i, t in rows}
    c = Counter(w for i, t in seen if crc(i, 7) != 2 for w in [*words(low(t)), None])
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), crc(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))
                      for (i, _), w in zip(rows, tokens, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language_scores_of_nothing(documents):
    assert hmm.language_scores(documents([])).count() == 0
    only = next(i for i in range(50) if crc(i, 7) == 2)
    row = hmm.language_scores(documents([(only, "held out")])).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


# --- ordinal regression -----------------------------------------------------------------------------------

def graded_rows(n=300):
    draw, rows, grades = random.Random(8), [], []
    for i in range(n):
        grade = i % 3
        w = [draw.choice(["alpha", "beta", "gamma", "delta"]) + str(draw.randint(0, 9)) for _ in range(draw.randint(10, 60))]
        for k in range(len(w)):
            if draw.random() < 0.3 * (2 - grade):
                w[k] += "%%%"
        rows.append((i, " ".join(w)))
        grades.append((i, grade))
    return rows, grades


def test_grades_in_order(spark, documents):
    rows, grades = graded_rows()
    got = {r.doc_id: r for r in ordinal.grade_quality(documents(rows), spark.createDataFrame(grades, "doc_id long, grade int"), 3).collect()}
    held = [(got[i].expected_grade, g) for i, g in grades if got[i].held_out]
    means = [np.mean([e for e, g in held if g == k]) for k in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.3
    for r in got.values():
        assert r.tails[0] >= r.tails[1] and abs(sum(r.tails) - r.expected_grade) < 1e-9 and r.kept == (r.tails[0] >= 0.5)
    assert np.mean([(e >= 0.5) == (g >= 1) for e, g in held]) > 0.8


def test_grades_of_odd_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = ordinal.grade_quality(documents(ODD), none, 3).collect()
    assert len(got) == len(ODD) and all(r.tails[0] > r.tails[1] for r in got)
    assert ordinal.grade_quality(documents([]), none, 3).count() == 0
    labels = labelled(spark, [(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, 0, 1)])
    assert sorted(map(tuple, ordinal.graded_labels(labels).collect())) == [(1, 0), (2, 1), (3, 2), (4, 0)]
    assert ordinal.graded_labels(labels).where(F.col("grade").isNull()).count() == 0
