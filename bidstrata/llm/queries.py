"""The text operators as queries over whole tables, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstrata.llm import (
    chat, decontaminate, hmm, infilling, mixing, neighbours, ordinal, passages, quality_rules, resampling, simhash,
    token_files, toxicity,
)
from bidstrata.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


#: Shares of expected words by language that the mixing query and the pipeline aim at.
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents' language, as the domain to learn."""
    return load(spark, sf_dir, "labels").select("doc_id").join(
        load(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS domain"), "doc_id")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, _ = mixing.mixing_rates(
        load(spark, sf_dir, "documents"), labelled_languages(spark, sf_dir), LANGUAGE_WEIGHTS)
    return rates.select("doc_id", "n_words", "posteriors", "rate")


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return token_files.write_and_digest(
        docs, public_tokenizers.path("word_bpe_49k.json"), 1, metadata=["lang", "source"])


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op5_passages"] = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM split
), run AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER s AS phrase, count(*) OVER s AS n
  FROM word WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS nth FROM run WHERE n = 20) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, range(0, 20) AS t(k)
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"))


@query
def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(load(spark, sf_dir, "documents"))


@query
def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = ordinal.grade_quality(
        load(spark, sf_dir, "documents"), ordinal.graded_labels(load(spark, sf_dir, "labels")), 3)
    return graded.select(
        "doc_id", "held_out", "expected_grade", F.get("tails", F.lit(0)).alias("p_good"), F.get("tails", F.lit(1)).alias("p_best"), "kept")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLES["op9_decontamination"] = r"""
WITH item AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS phrase, ws[i:i + 12] AS words, least(13, len(ws)) AS n
  FROM item, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0
), split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split
), run AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER s AS phrase, count(*) OVER s AS n
  FROM word WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), short AS (
  SELECT DISTINCT phrase, n, unnest(words) AS w, unnest(range(0, n)) AS k FROM win WHERE n < 13
), hit AS (
  SELECT doc_id, i, phrase, 13 AS n FROM run WHERE n = 13 AND phrase IN (SELECT phrase FROM win WHERE n = 13)
  UNION ALL
  SELECT doc_id, i - k, phrase, short.n FROM word JOIN short USING (w) GROUP BY doc_id, i - k, phrase, short.n HAVING count(*) = short.n
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (phrase)) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM split LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: A conversation that speaks in control strings.
_ODD = "\\### Assistant: </turn> ok"


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role").withColumn("text", F.lit(_ODD))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.write_and_digest(rows.unionByName(odd), public_tokenizers.path("byte_bpe_50k.json"))


ORACLES["op10_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
    length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 16 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(trained)) AS BIGINT) AS loss_chars,
  sha256(string_agg(trained, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.infilling_digest(load(spark, sf_dir, "documents"))


ORACLES["op11_infilling"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents
), drawn AS (
  SELECT *, len(lines) AS n, CAST('0x' || substr(digits, 1, 8) AS BIGINT) % (len(lines) + 1) AS one,
    CAST('0x' || substr(digits, 9, 8) AS BIGINT) % (len(lines) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(digits, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || substr(digits, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut
), part AS (
  SELECT *, array_to_string(lines[1:least(one, two)], '') AS prefix,
    array_to_string(lines[least(one, two) + 1:greatest(one, two)], '') AS middle,
    array_to_string(lines[greatest(one, two) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: CRCs are taken of distinct features only, a byte at a time over a table of the 256 one-byte steps.
ORACLES["op12_resampling"] = r"""
WITH step AS (
  SELECT list_transform(range(256), lambda c: list_reduce(range(8),
    lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, c)) AS t
), split AS (
  SELECT doc_id, true AS own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
  UNION ALL
  SELECT NULL, false, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark
), feature AS (
  SELECT doc_id, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM split
), counted AS (
  SELECT doc_id, own, f, count(*) AS n FROM feature GROUP BY ALL
), named AS (
  SELECT f, xor(list_reduce(list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), step
), held AS (
  SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM counted JOIN named USING (f) GROUP BY bucket
), whole AS (
  SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM held
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000)
    / ((coalesce(s, 0) + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g FROM held, whole
), weighed AS (
  SELECT doc_id, sum(n) AS n, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN named USING (f) JOIN gain USING (bucket) WHERE own GROUP BY doc_id
), scored AS (
  SELECT s.doc_id, len(ws) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || s.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS score
  FROM split s LEFT JOIN weighed w USING (doc_id) WHERE own
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS drawn FROM scored WHERE words >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"))
