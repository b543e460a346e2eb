"""Fill-in-the-middle by regular expressions that count.

``regexp_count`` says how many units (lines, by default) a text has. Two cut points turn into one pattern a row,
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z``, which takes the text apart and puts it together in the other order in a
single match. The groups are possessive: each takes its units one after another and never gives one back, so a match
is linear in the text and needs no stack, however many units there are. All of it stays in Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle. A text that holds one is left as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or a last line without one. Alternatives are tried left to right and are possessive.
LINES = r"[^\n]*+\n|[^\n]++"


def digest_numbers(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` (8 at most) eight-digit groups of the hex sha256 of ``seed:doc_id``, as longs. A null doc_id is
    written as nothing."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.sha2(name, 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(n)]


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, text, output) of every row: the units of its text, the form chosen and the text in that form.

    The cut points a <= b are drawn from 0 … n by the hash of doc_id and ``seed``. ``rate`` per cent of the texts that can
    be cut are: a text that is null, empty or holds a mark stays ``plain``. Of those cut, ``spm`` per cent give the
    suffix first (``spm``), the others the prefix (``psm``). The result depends on doc_id and text alone: repeated rows give
    equal rows, an empty table none; rows of one doc_id with different texts share draws, not cut points. ``text`` is the
    input with null as empty. Further columns are ignored. ``unit`` should be possessive (see ``LINES``) and must match
    at any place of any text, or the rest of the text after the last unit counts as suffix.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one, two, cut, order = digest_numbers(F.col("doc_id"), seed)
    drawn = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("bigint")).withColumns({
        "_a": F.least(one % (F.col("n") + 1), two % (F.col("n") + 1)),
        "_b": F.greatest(one % (F.col("n") + 1), two % (F.col("n") + 1)),
        "form": F.when(
            (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX))
            | F.contains("text", F.lit(MIDDLE)) | (cut % 100 >= rate), "plain"
        ).when(order % 100 < spm, "spm").otherwise("psm"),
    })
    pattern = F.concat(
        F.lit(f"(?s)\\A((?:{unit}){{"), F.col("_a").cast("string"), F.lit(f"}}+)((?:{unit}){{"),
        (F.col("_b") - F.col("_a")).cast("string"), F.lit("}+)(.*)\\z"))
    target = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, target))
    return drawn.withColumn("output", made).select("doc_id", "n", "form", "text", "output")


def parts_of(output: Column, form: Column) -> dict[str, Column]:
    """prefix, middle and suffix read back from an output; null where it is plain. No mark overlaps itself or another,
    and the texts hold none, so cutting at the marks is exact."""
    cut = F.split(output, "<[PSM]>")
    first, second, last = (F.get(cut, F.lit(k)) for k in (1, 2, 3))
    spm = form == "spm"
    cuttable = form != "plain"
    return {
        "prefix": F.when(cuttable, F.when(spm, second).otherwise(first)),
        "middle": F.when(cuttable, last),
        "suffix": F.when(cuttable, F.when(spm, first).otherwise(second)),
    }


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of, from output and form alone."""
    part = parts_of(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(part["prefix"], part["middle"], part["suffix"]))


def infilling_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``fill_in_middle``: lengths in
    code points, null where plain."""
    made = fill_in_middle(docs, **options)
    output, form = F.col("output"), F.col("form")
    part = parts_of(output, form)
    return made.select(
        "doc_id", "n", "form", F.char_length(part["prefix"]).cast("bigint").alias("prefix_chars"),
        F.char_length(part["middle"]).cast("bigint").alias("middle_chars"), F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, form), 256).alias("restored_sha256"))
