"""Mixing to target weights with soft membership, in DataFrame operations alone.

A naive Bayes classifier learnt from labelled rows gives every document posterior probabilities of domains. The rates
at which documents are to be used are the nonnegative least-squares solution nearest to the start: their expected
tokens per domain shall equal the targets. Each projected-gradient step needs one number per domain from all
documents, summed on the cluster; a document's rate follows from those numbers alone, so no step shuffles documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstrata.llm.common import free_names, settled

#: Labelled rows the classifier is fitted on at most (about), and hash buckets of words.
FIT_ROWS, BUCKETS = 20_000, 4_096
#: Evidence of a text counts as that of so many words at most, so that mixed texts keep mixed posteriors.
EVIDENCE_WORDS = 30
#: Domains at most by default: the driver solves a system of so many rows. Up to FEW_DOMAINS the sums are one row.
MAX_DOMAINS, FEW_DOMAINS = 512, 64


@dataclass(frozen=True)
class DomainModel:
    """Log probability of each word bucket by domain: (bucket, scores), and the domains' log priors."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    scores: DataFrame


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(buckets)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS,
                max_domains: int = MAX_DOMAINS) -> DomainModel:
    """Fit on ``labelled`` (doc_id, domain), thinned by a hash of doc_id to about ``fit_rows`` rows. Rows lacking
    either are left out; of several labels the least counts. More than ``max_domains`` domains are an error."""
    usable = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.col("domain").cast("string")).alias("domain"))
    total = usable.count()
    if total > fit_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * fit_rows / total))
    usable = settled(usable)
    share = {r.domain: r.n for r in usable.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(max_domains + 1).collect()}
    if len(share) > max_domains:
        raise ValueError(f"more than {max_domains} domains; see max_domains")
    names = tuple(share)
    if not names:
        return DomainModel((), (), docs.sparkSession.range(0).select(F.col("id").cast("int").alias("bucket")))
    taught = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # about fit_rows rows
    words = taught.select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''")
    counts = words.groupBy(_bucket(F.col("word"), buckets).alias("bucket"), "domain").agg(F.count("*").alias("n"))
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    by_bucket = counts.groupBy("bucket").agg(*[
        F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, d in enumerate(names)])
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(by_bucket, "bucket", "left")
    scores = [
        F.log((F.coalesce(F.col(f"n{k}"), F.lit(0)) + 0.5) / F.lit(totals.get(d, 0) + 0.5 * buckets)) for k, d in enumerate(names)]
    raw = every.select("bucket", *[s.alias(f"r{k}") for k, s in enumerate(scores)])
    mean = sum((F.col(f"r{k}") for k in range(1, len(names))), F.col("r0")) / len(names)
    table = raw.withColumn("mean", mean).select("bucket", *[(F.col(f"r{k}") - F.col("mean")).alias(f"s{k}") for k in range(len(names))])
    known = sum(share.values())
    return DomainModel(names, tuple(math.log(n / known) for n in share.values()), settled(table))


def domain_posteriors(docs: DataFrame, model: DomainModel, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(*key, n_words, posteriors): probabilities of ``model.domains`` by row; wordless texts get the priors.

    ``key`` must tell rows apart, or rows with equal keys count as one document.
    """
    words = docs.select(*key, F.explode(_words(F.col("text"))).alias("word")).withColumn("bucket", _bucket(F.col("word"), buckets))
    scored = words.join(F.broadcast(model.scores), "bucket")  # one row per bucket
    real = F.col("word") != ""
    n = len(model.domains)
    sums = scored.groupBy(*key).agg(F.count_if(real).alias("n_words"), *[
        F.coalesce(F.sum(F.when(real, F.col(f"s{k}"))), F.lit(0.0)).alias(f"s{k}") for k in range(n)])
    temper = F.least(F.lit(1.0), F.lit(float(EVIDENCE_WORDS)) / F.greatest(F.col("n_words"), F.lit(1)))
    logits = [F.col(f"s{k}") * temper + model.priors[k] for k in range(n)]
    top = F.greatest(*logits) if n > 1 else logits[0]
    raised = sums.select(*key, "n_words", F.array(*[F.exp(x - top) for x in logits]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.select(*key, "n_words", F.transform("e", lambda x: x / total).alias("posteriors"))


def _sums(now: DataFrame, loose: Column, amount: list[Column]) -> dict[str, float | None]:
    n = len(amount)
    return now.agg(
        *[F.sum(F.col("r") * amount[k]).alias(f"t{k}") for k in range(n)],
        *[F.sum(loose * amount[i] * amount[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first().asDict()


def _sums_by_row(now: DataFrame, loose: Column, amount: list[Column]) -> dict[str, float | None]:
    """The same sums, grouped by the first domain: the plan has a column a domain, not one a pair of them."""
    n = len(amount)
    each = now.select("*", F.posexplode("posteriors").alias("i", "p")).where("p <> 0")
    rows = each.groupBy("i").agg(
        F.sum(F.col("r") * F.col("n_words") * F.col("p")).alias("t"),
        *[F.sum(loose * F.col("n_words") * F.col("p") * amount[j]).alias(f"g{j}") for j in range(n)]).collect()
    found = {f"t{k}": None for k in range(n)} | {f"g{i}_{j}": None for i in range(n) for j in range(i, n)}
    for row in rows:
        found[f"t{row.i}"] = row.t
        found |= {f"g{row.i}_{j}": row[f"g{j}"] for j in range(row.i, n)}
    return found


def fit_rates(members: DataFrame, targets: Sequence[float], *, floor: float = 0.0, start: float = 1.0,
              rounds: int = 40, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """Add ``rate`` to ``members`` (n_words, posteriors): at least ``floor``, so that the sums over documents of
    rate x words x posterior equal ``targets``, or come as near as the bounds allow; and the share of the targets
    still missing after each round.

    Least squares in the metric in which a free step is exact: the gradient of a document is its words times its
    posteriors' product with G⁻¹ residual, G being the sum of the squares over documents that are off the bound.
    After k rounds a rate is a fold over the k steps, which each row evaluates by itself.
    """
    n = len(targets)
    amount = [F.col("n_words") * F.get("posteriors", F.lit(k)) for k in range(n)]

    def rate(steps: list[list[float]]) -> Column:
        # Most steps in one expression each would nest deeply; an array of steps is folded instead.
        if not steps:
            return F.greatest(F.lit(float(start)), F.lit(float(floor)))
        listed = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
        if n > FEW_DOMAINS:
            return F.aggregate(listed, F.greatest(F.lit(float(start)), F.lit(float(floor))), lambda r, s: F.greatest(
                r + F.col("n_words") * F.aggregate(F.zip_with(s, "posteriors", lambda x, p: x * p), F.lit(0.0), lambda a, x: a + x),
                F.lit(float(floor))))
        return F.aggregate(listed, F.greatest(F.lit(float(start)), F.lit(float(floor))), lambda r, s: F.greatest(
            r + sum((F.get(s, F.lit(k)) * amount[k] for k in range(1, n)), F.get(s, F.lit(0)) * amount[0]), F.lit(float(floor))))

    steps: list[list[float]] = []
    missing: list[float] = []
    scale = sum(abs(t) for t in targets) or 1.0
    for _ in range(rounds + 1):
        now = members.select("n_words", "posteriors", rate(steps).alias("r"))
        loose = F.when(F.col("r") > floor, 1.0).otherwise(0.05)
        sums = _sums(now, loose, amount) if n <= FEW_DOMAINS else _sums_by_row(now, loose, amount)
        residual = [targets[k] - (sums[f"t{k}"] or 0.0) for k in range(n)]
        missing.append(sum(map(abs, residual)) / scale)
        if missing[-1] < tolerance or len(steps) == rounds:
            break
        gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        ridge = 1e-9 * max(gram.diagonal().max(), 1e-9)
        steps.append(np.linalg.solve(gram + ridge * np.eye(n), residual).tolist())
        if len(missing) > 3 and missing[-1] > 0.999 * missing[-3]:
            break  # the bounds keep it from coming nearer
    return members.withColumn("rate", rate(steps)), missing


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], *, tokens: float | None = None, floor: float = 0.0,
    fit_rows: int = FIT_ROWS, max_domains: int = MAX_DOMAINS,
) -> tuple[DataFrame, tuple[str, ...]]:
    """(doc_id, text_hash, n_words, posteriors, rate) of each distinct row of ``docs``, and the domains in order.

    ``weights``: the share of expected words that each domain shall have; a domain without one gets none, weights of
    unknown domains are left out, and what remains is scaled to sum to 1. ``tokens``: expected words in all. The
    default is as many as there are; with a ``floor`` of 1 (keep every document, repeat some), as many as the most
    over-represented domain calls for. ``max_domains``: labelled rows of more domains are an error; the driver holds and
    solves a system of as many rows and columns each round.

    Rows alike in doc_id and text are one document here and share its rate. Texts without words have rate ``floor`` or
    1, whichever is higher. Without labelled rows, words or weights every rate is 1.
    """
    model = fit_domains(docs, labelled, fit_rows, max_domains=max_domains)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    wanted = [max(float(weights.get(d, 0.0)), 0.0) for d in model.domains]
    if not sum(wanted):
        n = F.size(F.filter(_words(F.col("text")), lambda w: w != "")).cast("long")
        return keyed.select("doc_id", "text_hash", n.alias("n_words"), F.array().cast("array<double>").alias("posteriors"),
                            F.lit(1.0).alias("rate")).distinct(), model.domains
    wanted = [w / sum(wanted) for w in wanted]
    members = settled(domain_posteriors(keyed, model, ["doc_id", "text_hash"]))
    have = members.agg(*[
        F.coalesce(F.sum(F.col("n_words") * F.get("posteriors", F.lit(k))), F.lit(0.0)).alias(f"h{k}") for k in range(len(wanted))]).first()
    if not sum(have):
        return members.withColumn("rate", F.lit(1.0)), model.domains
    if tokens is None:
        tokens = max(h / w for h, w in zip(have, wanted, strict=True) if w) if floor >= 1 else sum(have)
    rated, _ = fit_rates(members, [w * tokens for w in wanted], floor=floor)
    return rated, model.domains


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with each row repeated floor(rate) or one more times, the latter with the rate's fraction as
    probability, decided by a hash of doc_id and text: the same rows every run."""
    key, digest, rate, times = free_names(docs, "mix_id", "mix_hash", "mix_rate", "mix_times")
    keys = rates.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("rate").alias(rate))
    joined = docs.join(keys, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(digest)))
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(key), F.col(digest)), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor(rate)
    n = (whole + F.when(chance < F.col(rate) - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), n))).select(*[docs[c] for c in docs.columns])
