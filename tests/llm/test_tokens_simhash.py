"""Token files and SimHash against plain computations."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidstrata.llm import components, simhash, token_files
from tests.llm.conftest import ODD, low, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def text_key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_equal_direct_encoding(spark, documents, tmp_path, encoding):
    tokenizer = Tokenizer.from_file(PATH)
    token_files.write_tokens(documents(ODD), str(tmp_path / "t"), PATH, 1, metadata=["lang", "shard"], encoding=encoding)
    read = token_files.read_tokens(spark, str(tmp_path / "t"))
    got = [(r.doc_id, r.start, list(r.tokens)) for r in read.orderBy("start").collect()]
    expected, start = [], 0
    for i, text in sorted(ODD, key=text_key):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, ids))
        start += len(ids)
    assert got == expected
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(read).collect()}
    assert digests == {(s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, ids in expected}
    assert read.where("doc_id = 4").select("n_tokens").collect()[0][0] == 2 and "lang" in read.columns


def test_token_files_of_nothing(spark, documents, tmp_path):
    token_files.write_tokens(documents([]), str(tmp_path / "t"), PATH, 1)
    assert token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "t"))).count() == 0
    with pytest.raises(ValueError, match="encoding"):
        token_files.write_tokens(documents([]), str(tmp_path / "u"), PATH, 1, encoding="none")


def test_word_encoder_equals_whole_texts_for_random_marks():
    draw, tokenizer, encoder = random.Random(3), Tokenizer.from_file(PATH), token_files.WordEncoder(PATH)
    for _ in range(300):
        text = " ".join("".join(draw.choice("aBÉ'.,|<>%1́İΣあ-") for _ in range(draw.randint(1, 6))) for _ in range(5))
        got = b"".join(encoder.encode([low(w) for w in words(text)]))
        assert np.frombuffer(got, np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def fingerprint(text):
    w = words(low(text))
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    set_bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            set_bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * set_bits[b] > len(grams))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprints_and_components_of_odd_rows(documents):
    got = simhash.simhash_components(documents(ODD)).collect()
    fps = [fingerprint(t) for _, t in ODD]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(len(fps), links)
    least = {}
    for (i, _), r in zip(ODD, root, strict=True):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(
        ((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(ODD, fps, root, strict=True)), key=key)


@pytest.mark.parametrize("hot", [4096, 2])
def test_no_link_is_lost(spark, monkeypatch, hot):
    """Random points and points within three bits of others, with and without split anchors."""
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    draw = random.Random(5)
    points = [draw.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        p = draw.choice(points)
        for b in draw.sample(range(64), draw.randint(1, 4)):
            p ^= 1 << b
        points.append(p)
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    found = {(r.a, r.b) for r in simhash.fingerprint_links(fps).collect()}
    at = {p: k for k, p in enumerate(signed)}
    expected = roots(len(points), [
        (a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= 3])
    assert roots(len(points), [(at[a], at[b]) for a, b in found]) == expected


def test_anchors_cover():
    half = np.array([random.Random(1).getrandbits(32) for _ in range(300)], np.uint32)
    home, rows, others = simhash.anchors(half)
    assert (np.bitwise_count(home ^ half) <= 1).all() and (np.bitwise_count(others ^ half[rows]) <= 2).all()
    near = half ^ (np.uint32(1) << np.uint32(7))
    _, rows, others = simhash.anchors(near)
    near_home, _, _ = simhash.anchors(near)
    for k in range(len(half)):
        assert home[k] in {near_home[k], *others[rows == k]}


def test_one_of_each_component_stays(documents):
    base = " ".join(f"w{k}" for k in range(400))
    near = base.replace("w399", "other")
    rows = [(9, base), (3, near), (5, base), (5, base), (7, "apart from them"), (8, None), (2, ""), (None, "alone here")]
    left = simhash.keep_one(documents(rows))
    assert left.columns[:2] == ["doc_id", "text"] and len(left.columns) == 7
    assert sorted(((r.doc_id or -1), r.text or "") for r in left.collect()) == [(-1, "alone here"), (2, ""), (3, near), (7, "apart from them")]
    assert simhash.keep_one(documents([])).count() == 0


def test_components_of_chain_star_and_nothing(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    links = spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")
    got = {r.a: r.root for r in components.least_reachable(links).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}}
    assert components.least_reachable(links.where(F.lit(False))).count() == 0
