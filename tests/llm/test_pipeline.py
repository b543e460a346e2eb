"""The pipeline's stages, each against a plain computation on its own input."""

import os
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from bidstrata.llm import mixing, toxicity
from tests.conftest import SF
from tests.llm.conftest import ODD
from tests.llm.test_texts import contaminated
from tests.llm.test_tokens_simhash import fingerprint, roots


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((docs, done))
        docs = done
    return out


def test_stages_are_registered():
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in entry.queries()
    own = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in own) == list(range(1, 14))


def test_all_but_the_last_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxicity_drops_what_the_model_rejects(spark, stages):
    before, after = stages[0]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in scored.where("predicted = 0").collect()} == {r.doc_id for r in after.collect()}
    clean = {i for i, quality, toxic in table("labels") if not toxic}
    assert not clean & ({r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()})


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1])
    ids = sorted(before)
    fps = [fingerprint(before[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert set(after) == {ids[r] for r in roots(len(ids), links)}


def test_contaminated_documents_go(stages):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in stages[2])
    found = contaminated(before, table("benchmark"))
    assert sorted(i for i, _ in after) == sorted(i for i, *_, bad in found if not bad)


def test_mixing_repeats_by_rate(spark, stages):
    before, after = stages[3]
    rates, names = mixing.mixing_rates(
        before, corpus_pipeline.labelled_languages(spark, SF), corpus_pipeline.LANGUAGE_WEIGHTS, floor=1.0)
    rate = {r.doc_id: r.rate for r in rates.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert set(times) == set(rate) and all(abs(times[i] - rate[i]) < 1 for i in rate)
    got = rates.collect()
    sums = np.array([sum(r.rate * r.n_words * r.posteriors[k] for r in got) for k in range(len(names))])
    assert np.allclose(sums / sums.sum(), [corpus_pipeline.LANGUAGE_WEIGHTS[n] for n in names], atol=1e-3)


def test_token_files_hold_every_row(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = after.orderBy("start").collect()
    for row, (doc, text) in zip(got, sorted((r.doc_id, r.text) for r in before.collect()), strict=True):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        assert (row.doc_id, row.start, row.n_tokens) == (doc, start, n)
        start += n


def test_run_equals_the_stages(spark, stages):
    assert sorted(rows(corpus_pipeline.run(spark, SF))) == sorted(rows(stages[-1][1]))


ORACLES = [n for n in entry.TEXT_ORACLES]


@pytest.mark.parametrize("name", ORACLES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    expected = con.sql(entry.TEXT_ORACLES[name])
    columns = sorted(expected.columns)
    df = entry.TEXT_QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(rows(df.select(columns))) == sorted(expected.select(*columns).fetchall())


CLASHING = ["gone_id", "gone_hash", "mix_id", "mix_hash", "mix_rate", "mix_times", "toxicity", "fp", "text_hash", "_gone", "_hash", "_mix_rate",
            "_toxicity", "rate", "shard", "offset", "n_tokens", "tokens", "row", "root", "first", "phrase", "anchor"]


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows_and_clashing_names(spark, documents, name, stage):
    docs = with_clashes(documents(ODD).drop("fp", "rate").withColumn("n_chars", F.length("text").cast("long")))
    done = stage(spark, docs, SF)
    got = done.collect()
    if name == "token_files":
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == sorted(-1 if i is None else i for i, _ in ODD)
        return
    assert done.columns == docs.columns
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING)
    left = Counter((r.doc_id, r.text) for r in got)
    if name == "mixing":
        assert set(left) == set(ODD) and all(n >= Counter(ODD)[row] for row, n in left.items())
    elif name == "simhash_dedup":  # texts without words are alike; of them the least named one stays
        kept = {(0, ODD[0][1]), (1, None), (4, "word"), (5, ODD[5][1]), (6, "same text here"), (None, "no id"), (8, ODD[12][1]), (9, ODD[13][1])}
        assert set(left) >= kept and set(left.values()) == {1}
        assert not {(2, ""), (3, " \t\n"), (None, None)} & set(left)
    else:  # nothing here is toxic or benchmark text
        assert left == Counter(ODD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_an_empty_table(spark, documents, name, stage):
    docs = with_clashes(documents([]).drop("fp", "rate"))
    done = stage(spark, docs, SF)
    assert done.collect() == [] and (name == "token_files" or done.columns == docs.columns)
