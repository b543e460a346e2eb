"""Fill-in-the-middle, importance resampling and nearest neighbours against plain computations."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidstrata.llm import infilling, neighbours, resampling
from tests.conftest import SF
from tests.llm.conftest import ODD, low


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def draws(doc_id, n=4):
    digits = sha(f"7:{'' if doc_id is None else doc_id}")
    return [int(digits[8 * k:8 * k + 8], 16) for k in range(n)]


# --- fill-in-the-middle ---------------------------------------------------------------------------

def infilled(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    one, two, cut, order = draws(doc_id)
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or cut % 100 >= rate:
        return len(units), "plain", None, None, text
    if order % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINED = [
    *ODD, (20, "a\nb\nc"), (21, "\n\n\n"), (22, "one\r\ntwo\r\n\u2028three"), (23, "x <P> y\nz"), (24, "<S"), (25, "$1 \\2\n\\E$0\n{3}"),
    (26, "😀\n" * 9 + "ende"), (27, "<\nP>\n<"), (28, "line\n" * 300_000), (29, "é" * 500_000), (20, "a\nb\nc"),
]


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (100, 100)])
def test_infilling_equals_lists_of_lines(documents, rate, spm):
    got = infilling.infilling_digest(documents(LINED), rate=rate, spm=spm).collect()
    assert Counter(map(tuple, got)) == Counter(
        (i, n, form, p, m, sha(out), sha(text or "")) for i, text in LINED for n, form, p, m, out in [infilled(i, text, rate, spm)])


def test_texts_are_rebuilt_from_output_and_form(spark, documents):
    made = infilling.fill_in_middle(documents(LINED))
    assert not made.where(infilling.restored(F.col("output"), F.col("form")) != F.col("text")).count()
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    assert infilling.infilling_digest(documents(LINED).where("false")).collect() == []


def test_words_can_be_units(documents):
    rows = [(i, f"to  be or not {'to be ' * i}") for i in range(20)]
    made = infilling.fill_in_middle(documents(rows), unit=r"\S++\s*+").collect()
    assert all(r.n == len(r.text.split()) for r in made)
    for r in made:
        cut = dict(zip(re.findall("<(.)>", r.output), re.split("<[PSM]>", r.output)[1:], strict=True))
        assert cut["P"] + cut["M"] + cut["S"] == r.text


# --- importance resampling ------------------------------------------------------------------------

def features(text, longest=2):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(ws), [zlib.crc32(" ".join(ws[i:i + n]).encode()) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB9ß 日\n.~\x00"), max_size=80), st.integers(1, 4), st.sampled_from([1, 2, 7, 1000]))
def test_crcs_from_prefixes_are_those_of_the_ngrams(text, longest, block):
    before, resampling.BLOCK_WORDS = resampling.BLOCK_WORDS, block
    try:
        got = list(resampling.feature_crcs(text.encode(), longest))
    finally:
        resampling.BLOCK_WORDS = before
    n, expected = features(text, longest)
    assert sorted(int(c) for crcs, _ in got for c in crcs) == sorted(expected) and sum(w for _, w in got) == n


def test_crcs_of_long_words_and_blocks():
    text = " ".join(["x" * k for k in (1, 62, 63, 64, 65, 300, 70_000)] * 3) + " tail" * 250_000
    got = sorted(int(c) for crcs, _ in resampling.feature_crcs(text.encode(), 2) for c in crcs)
    assert got == sorted(features(text)[1])


def resampled(docs, target, percent=25, buckets=10_000):
    own, aim = Counter(), Counter()
    for held, rows in ((own, docs), (aim, target)):
        for _, text in rows:
            held.update(c % buckets for c in features(text)[1])
    s, t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1.0) * (t * 0 + s + buckets) / ((own[b] + 1.0) * (t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[c % buckets] for c in found) // len(found) if found else 0
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((draws(i, 1)[0] + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(fit[:percent * len(fit) // 100], 1)}
    return Counter((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling_equals_counted_ngrams(spark, documents, percent):
    rows = [*ODD, *[(i, f"alpha beta {'gamma ' * (i % 30)} w{i % 7} Delta" * 2) for i in range(100, 180)], (120, "again " * 25), (8, "long " * 3000)]
    target = [("x", "gamma gamma w3 delta"), ("y", None), ("z", "")]
    bench = spark.createDataFrame(target, "item_id string, text string")
    got = resampling.resample(documents(rows), bench, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled(rows, target, percent)


def test_resampling_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resample(documents(ODD).where("false"), bench).collect() == []
    assert Counter(map(tuple, resampling.resample(documents(ODD), bench).collect())) == resampled(ODD, [])


def test_repeated_rows_are_ranked_apart(spark, documents):
    rows = [(5, "same words " * 20)] * 40 + [(i, f"other {i} " * 20) for i in range(60, 80)]
    got = resampling.resample(documents(rows), spark.createDataFrame([("a", "same")], "item_id string, text string"), percent=50)
    ranks = sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 31))


# --- nearest neighbours ---------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rep int, cell string").repartition(3)


def brute(rows, asked, k=10):
    """{query: [(score, id)]} over rows that may take part."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 3:
            good.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in asked:
        if q in good:
            best = sorted((min(math.dist(a, b) for a in good[q] for b in good[i]), i) for i in good if i != q)[:k]
            out[q] = [(round(s, 9), i) for s, i in best]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


NAN, INF = float("nan"), float("inf")
STRANGE = [
    (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [NAN, 1.0, 1.0]), (6, [INF, 1.0, 1.0]),
    (7, [0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (8, []), (100, [0.0, 2.0, 0.0]), (100, [0.0, 2.0, 0.0]), (200, None), (9, [0.0, 3.0, 0.0]),
    (9, [5.0, 3.0, 0.0]), (10, [0.0, 1.0, 0.0]), (300, [9.0, 9.0, 9.0]), (300, [1.0, 0.1, 0.0]),
]


def test_strange_vectors_take_no_part(spark):
    df = vectors(spark, STRANGE)
    got = listed(neighbours.nearest(df, df.where("vec_id % 100 = 0")))
    assert got == brute(STRANGE, [0, 100, 200, 300]) and set(got) == {0, 100, 300}
    assert neighbours.nearest(df.where("false"), df.where("false")).collect() == []
    assert neighbours.nearest(df, df.where("vec_id = 3")).collect() == []
    alone = df.where("vec_id = 100")
    assert neighbours.nearest(alone, alone).collect() == []


def test_copies_are_all_counted_and_ties_go_to_smaller_ids(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, draw.normal(size=3).round(1).tolist()) for i in range(300, 700)]
    df = vectors(spark, rows)
    got = listed(neighbours.nearest(df, df.where("vec_id % 100 = 0"), recall=0.999))
    want = brute(rows, range(0, 700, 100))
    assert got[0] == want[0] == [(0.0, i) for i in range(1, 11)] and got[100] == want[100] == [(0.0, i) for i in range(10)]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_every_block_meets_every_other(spark, block):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(120)]
    df = vectors(spark, rows)
    whole = neighbours.Hashing(3, 1, 1, 1e6, 1)  # one or two cells, both visited
    got = listed(neighbours.nearest(df, df.where("vec_id % 10 = 0"), hashing=neighbours.Hashing(3, 2, 1, 1e6, 3), block=block))
    assert got == brute(rows, range(0, 120, 10)) and whole.tables == 1


def test_queries_that_find_too_few_are_compared_with_all(spark):
    rows = [(i, [float(i + 1), 1.0, 0.0]) for i in range(40)] + [(500, [-1e9, 3.0, 2.0])]
    df = vectors(spark, rows)
    narrow = neighbours.Hashing(3, 1, 2, 1e-3, 1)
    assert listed(neighbours.nearest(df, df.where("vec_id IN (0, 20, 500)"), hashing=narrow)) == brute(rows, [0, 20, 500])


def test_probes_rise_by_expected_score():
    order = neighbours.probe_order(4, 81)
    assert len(order) == 81 and not order[0].any() and len({tuple(r) for r in order}) == 81  # every cell around once
    z = [j * (j + 1) / 120 for j in range(1, 5)] + [1 - j / 5 + j * (j + 1) / 120 for j in range(4, 0, -1)]
    scores = order @ np.array(z)
    assert (np.diff(scores) >= -1e-12).all() and not (order[:, :4] & order[:, :3:-1]).any()


def test_visits_are_the_cells_around(spark):
    draw = np.random.default_rng(9)
    hashing = neighbours.Hashing(5, 2, 3, 0.7, 27)
    a = draw.normal(size=(50, 5))
    near = hashing.cells(a + 0.05 * draw.normal(size=a.shape))
    visited = hashing.visits(a)
    assert (visited[:, :, 0] == hashing.cells(a)).all()
    first = [[int(np.flatnonzero(visited[i, t] == near[i, t])[0]) for t in range(2)] for i in range(50)]  # all are found
    assert np.mean(np.array(first) < 4) > 0.8


def test_recall_of_the_registered_query(spark):
    from bidstrata.llm.queries import QUERIES

    rows = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = listed(QUERIES["op13_neighbours"](spark, SF))
    assert sorted(got) == sorted(i for i, _ in rows if i % 100 == 0)
    hit = 0
    for q, found in got.items():
        (mine,) = [v for i, v in rows if i == q]
        true = sorted((float(np.sqrt(((v - mine) ** 2).sum())), i) for i, v in rows if i != q)[:10]
        hit += len({i for _, i in true} & {i for _, i in found})
        exact = dict((i, float(np.sqrt(((v - mine) ** 2).sum()))) for i, v in rows)
        assert all(abs(s - exact[i]) < 1e-8 for s, i in found) and len(found) == 10
    assert hit >= 0.9 * 10 * len(got)
