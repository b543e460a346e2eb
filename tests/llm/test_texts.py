"""Passages, decontamination, quality rules, chat: against plain computations."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from bidstrata.llm import chat, decontaminate, passages, quality_rules
from tests.llm.conftest import ODD, low, words

CHAT = public_tokenizers.path("byte_bpe_50k.json")


# --- passages ---------------------------------------------------------------------------------------

def without_repeats(rows):
    """Rows are (doc_id, text), unique."""
    first, out = {}, []
    split = [(i, words(t)) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    for i, w in split:
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k:k + 20]), (i, k))
    for i, w in split:
        gone = {k + j for k in range(len(w) - 19) if first[tuple(w[k:k + 20])] != (i, k) for j in range(20)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "patterns", "group"), [(200_000, 20_000, 10_000), (1, 3, 1), (4, 1, 5)])
def test_repeated_passages(documents, monkeypatch, hot, patterns, group):
    monkeypatch.setattr(passages, "HOT_ANCHOR", hot)
    monkeypatch.setattr(passages, "AUTOMATON_PATTERNS", patterns)
    monkeypatch.setattr(passages, "GROUP_ROWS", group)
    draw = random.Random(2)
    passage = [f"p{k}" for k in range(60)]
    rows = [(None, " ".join(passage[:30]))]
    for i in range(30):
        own = [f"d{i}w{k}" for k in range(draw.randint(0, 40))]
        a = draw.randint(0, 35)
        rows.append((i, " ".join([*own, *passage[a:a + draw.randint(0, 30)], *own[:25], *(["same"] * draw.choice([0, 22, 25]))])))
    rows += [(50, rows[5][1]), (51, None), (52, ""), (53, "x " * 19), (54, "x " * 20), (55, "x " * 45),
             *[(60 + k, " ".join(f"v{j % (7 + k)}{k}" for j in range(20 + 3 * k))) for k in range(12)]]
    got = passages.without_repeats(documents(rows))
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats(rows)


@pytest.mark.parametrize("letters", [passages.LETTERS, 30, 2])
def test_segments_with_more_words_than_characters(monkeypatch, letters):
    monkeypatch.setattr(passages, "LETTERS", letters)
    draw = random.Random(2)
    for _ in range(40):
        base = [f"w{draw.randrange(40)}" for _ in range(60)]
        segments = {" ".join(w if draw.random() < 0.98 else f"n{draw.randrange(1000)}" for w in base[a:a + draw.randint(20, 34)])
                    for a in (draw.randrange(26) for _ in range(20))}
        segments = list(segments)
        first, expected = {}, set()
        for row, segment in enumerate(segments):
            ws = segment.split(" ")
            for k in range(len(ws) - 19):
                if first.setdefault(tuple(ws[k:k + 20]), (row, k)) != (row, k):
                    expected.add((row, k))
        assert {(row, k + j) for row, k, n in passages._locate(segments) for j in range(n)} == expected
    many = [" ".join(f"a{i}_{k}" for k in range(25)) for i in range(50_000)]  # more different words than characters
    assert passages._locate([*many, many[7] + " x"]) == [(50_000, 0, 6)]


def test_passages_of_odd_rows(documents):
    text = " ".join(f"t{k}" for k in range(25))
    got = passages.without_repeats(documents([(1, text), (1, text), (1, text + " end"), (None, None)])).collect()
    assert len(got) == 4 and sorted(r.n_removed for r in got)[:2] == [0, 0]
    # Two rows are one document; of the two texts of doc_id 1 one is the earlier, by a hash.
    assert sorted(r.n_removed for r in got) in ([0, 0, 0, 25], [0, 0, 25, 25])
    assert passages.without_repeats(documents([])).count() == 0
    assert len(passages.without_repeats(documents(ODD)).collect()) == len(ODD)


# --- decontamination --------------------------------------------------------------------------------

def bench_words(text):
    return "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or not c.isascii() else " " for c in low(text)).split(" ")


def contaminated(rows, items):
    grams = {}
    for item, text in items:
        w = [x for x in bench_words(text) if x]
        for k in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[k:k + 13]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = [x for x in bench_words(text) if x], set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if tuple(w[k:k + n]) in grams and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k:k + n])]
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def benchmark_case():
    draw = random.Random(4)
    common = ["the", "of", "and", "Été", "K2"]
    item = [draw.choice(common) if k % 2 else f"q{k}" for k in range(30)]
    items = [(10, " ".join(item)), (9, " ".join(item[:13])), (2, "The, the of"), (3, None), (4, "..."), (5, "the " * 14), (2, "the, THE of")]
    rows = [*ODD]
    for i in range(20, 50):
        own = [draw.choice([*common, f"x{i}"]) for _ in range(draw.randint(0, 300))]
        at, n = draw.randint(0, 20), draw.choice([0, 12, 13, 25])
        rows.append((i, ", ".join(own) + "; " + " ".join(item[at:at + n]).upper() + "! " + " ".join(own[:5])))
    return rows, items


def test_contamination(spark, documents):
    rows, items = benchmark_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(rows), bench)
    assert sorted(map(tuple, got.drop("text_hash").collect()), key=str) == contaminated(rows, items)
    kept = decontaminate.without_contaminated(documents(rows), bench)
    assert len(kept.columns) == 7
    assert kept.count() == sum(not r[-1] for r in contaminated(rows, items))


def test_contamination_joined_by_shuffle(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows, items = benchmark_case()
    got = decontaminate.contamination(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.drop("text_hash").collect()), key=str) == contaminated(rows, items)


def test_contamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents([]), none).count() == 0
    assert not [r for r in decontaminate.contamination(documents(ODD), none).collect() if r.contaminated or r.n_hit]


def test_proximity(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents([(1, "alpha x beta y gamma"), (2, "alpha beta gamma"), (3, "gamma " + "z " * 30 + "alpha"), (4, "beta")])
    index = decontaminate.build_index(docs, bench)
    near = {(r.doc_id, r.apart) for r in decontaminate.proximity_matches(index, 3).collect()}
    assert {d for d, _ in near} == {1, 2} and (2, 0) in near and (1, 0) not in near


# --- quality rules ----------------------------------------------------------------------------------

def described(text):
    text, w = text or "", words(text)
    grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_and_verdicts(documents):
    clean = [(100 + k, " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(60)) + ".\nEnd.") for k in range(40)]
    junk = [(200 + k, " ".join(f"word{(k + j * 3) % 89}%%%" for j in range(50))) for k in range(15)]
    repeats = [(300, "a b c d e f g h i j " * 5), (301, "a " * 9), (302, "line one is this\nline one is this\n\n\n" + "z " * 25)]
    rows = [*ODD, *clean, *junk, *repeats]
    got = quality_rules.judge_quality(documents(rows)).collect()
    key = str
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(((i, *described(t)) for i, t in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _ in clean} <= kept and not {i for i, _ in junk} & kept
    assert quality_rules.judge_quality(documents([])).count() == 0


def test_rules_learn_who_is_reliable():
    draw = random.Random(1)
    patterns = Counter()
    for _ in range(4000):
        bad = draw.random() < 0.2
        good = [-1 if (draw.random() < (0.9 if bad else 0.03)) else 1 for _ in range(3)]
        noisy = draw.choice([1, -1, 0])
        patterns[(*good, noisy)] += 1
    model = quality_rules.fit_rules(sorted(patterns.items()), 4)
    assert abs(model.shares[0] - 0.8) < 0.05
    assert min(model.accuracies[:3]) > 0.9 and model.accuracies[3] < 0.75
    assert quality_rules.fit_rules([], 4).shares


# --- chat -------------------------------------------------------------------------------------------

CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <b>"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello <b>"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 1, "assistant", "\\### Assistant: </turn> ok"), (4, 0, "user", "</turn>\n<turn user>"),
    (5, 0, None, None), (6, 0, "assistant", ""), (7, 0, "a>\\", "b\\"), (8, 0, "user", "twice"), (8, 0, "user", "twice"),
    (9, None, "user", "no turn"), (None, 0, "user", "nobody"), (None, 1, "assistant", "me"), (10, 0, "assistant", "<|endoftext|> é中 " * 50),
]


def conversation_digests(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(chat.formatted(r, t))) for *_, r, t in turns)))
    return sorted(out, key=str)


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, node string").repartition(3)
    assert sorted(map(tuple, chat.write_and_digest(df, CHAT).collect()), key=str) == conversation_digests(CONVERSATIONS)
    assert chat.write_and_digest(df.limit(0), CHAT).count() == 0


def test_shared_turns_are_written_once_and_seen(spark, tmp_path):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").coalesce(1)
    chat.write_tree(df, str(tmp_path), CHAT)
    nodes = {(r.shard, r.node): r for r in chat.read_nodes(spark, str(tmp_path)).collect()}
    turns = {}
    for r in chat.read_turns(spark, str(tmp_path)).orderBy("depth").collect():
        turns.setdefault(r.conv_id, []).append((r.shard, r.node))
    if turns[1][0][0] == turns[2][0][0]:
        assert turns[1] == turns[2][:2]
    for path in turns.values():
        position, seen = 0, set()
        for key in path:
            node = nodes[key]
            assert node.position == position
            assert {x for a, b in node.attention for x in range(a, b)} == seen
            seen |= set(range(node.start, node.start + len(node.tokens)))
            position += len(node.tokens)
    for shard in {s for s, _ in nodes}:
        at = 0
        for node in sorted((n for (s, _), n in nodes.items() if s == shard), key=lambda n: n.start):
            assert node.start == at
            at += len(node.tokens)


def test_escapes():
    for role, text in [("user", "a\\<b>\n</turn>\n"), ("<>", "\\\\"), ("", "")]:
        assert chat.parse_turn("".join(chat.formatted(role, text))) == (role, text)
    with pytest.raises(ValueError, match="turn"):
        chat.parse_turn("<turn user>\na</turn>\nmore")
