"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

A posting is one place of one term in one training text, with the words around it. The index holds the postings of the
terms that searches start from: of every benchmark window its two rarest terms by the corpus's own counts. A term's
place less its offset in the window is where the window would start; the lists of the two terms are intersected on
(window, text, start), and what both support is compared with the words around. Near places in other arrangements
are proximity matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstrata.llm.common import settled, without_rows

WINDOW = 13
#: A benchmark with more search terms or terms than this is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 500_000
#: Delimiters of words, and A-Z, which lower-casing later turns into word characters.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Index:
    """``docs``: (doc_id, text_hash, n_words) of each row. ``windows``: distinct windows with their search terms.
    ``items``: which items hold which windows. ``postings``: (term, doc_id, text_hash, place, near, at)."""

    docs: DataFrame
    windows: DataFrame
    items: DataFrame
    postings: DataFrame
    n_windows: int


def _split(text: Column) -> Column:
    """Words, in their own case. The first and the last may be empty, which matches nothing and moves places alike."""
    return F.split(F.coalesce(text, F.lit("")), _GAPS)


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, words): each run of ``window`` words of each item, lower-cased; items of fewer words, but
    not none, whole. Null and wordless items have none; repeated items and windows count once."""
    words = F.filter(F.split(_lower(F.coalesce("text", F.lit(""))), _GAPS), lambda w: w != "")
    items = benchmark.select("item_id", words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    return (
        items.withColumn("start", F.explode(starts))
        .select("item_id", F.slice("all", F.col("start"), window).alias("words"))
        .select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()
    )


def build_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> Index:
    """Index ``docs`` for the windows of ``benchmark``. Three scans of the texts: lengths, term counts, postings."""
    split = _split(F.col("text"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), split.alias("ws"))
    edges = F.when(F.element_at("ws", 1) == "", 1).otherwise(0) + F.when(
        (F.size("ws") > 1) & (F.element_at("ws", -1) == ""), 1).otherwise(0)
    lengths = texts.select("doc_id", "text_hash", (F.size("ws") - edges).cast("long").alias("n_words"))

    # Terms are compared lower-cased in full here, so that ASCII words take the quick path; phrases are exact.
    items = settled(item_windows(benchmark, window))
    terms = items.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).distinct()
    n_terms = terms.count()
    seen = (
        docs.select(F.explode(split).alias("word")).select(F.lower("word").alias("term"))
        .join(_small(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("rows"))
    )
    counts = settled(terms.join(seen, "term", "left").select("term", F.coalesce("rows", F.lit(0)).alias("rows")))

    placed = (
        items.select("phrase", "words").distinct()
        .select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
        .withColumn("term", F.lower("word")).join(_small(counts, n_terms), "term")
        .groupBy("phrase", "length", "term").agg(F.min(F.struct("rows", "offset")).alias("best"))
        .groupBy("phrase", "length").agg(  # at most `window` entries
            F.sort_array(F.collect_list(F.struct("best.rows", "term", "best.offset"))).alias("by_count"))
    )
    rarest = F.element_at("by_count", 1)
    second = F.get("by_count", F.lit(1))
    windows = settled(placed.select(
        "phrase", "length", rarest["term"].alias("term1"), rarest["offset"].alias("offset1"),
        second["term"].alias("term2"), second["offset"].alias("offset2")).where(rarest["rows"] > 0))

    search = windows.select(F.explode(F.array("term1", "term2")).alias("term")).where("term IS NOT NULL").distinct()
    n_search = search.count()
    first = F.greatest(F.col("place") - (window - 2), F.lit(1))  # the words `window - 1` to either side
    postings = settled(
        texts.select("doc_id", "text_hash", "ws", F.posexplode("ws").alias("place", "word"))
        .withColumn("term", F.lower("word")).join(_small(search, n_search), "term")
        .select("term", "doc_id", "text_hash", "place", F.slice("ws", first, 2 * window - 1).alias("near"),
                (first - 1).alias("at"))
    )
    return Index(lengths, windows, items, postings, windows.count())


def _lists(index: Index, nth: int, *columns: str) -> DataFrame:
    """Postings of each window's first or second search term, and where the window would start."""
    wanted = index.windows.where(f"term{nth} IS NOT NULL").withColumnRenamed(f"term{nth}", "term")
    return index.postings.join(_small(wanted, index.n_windows), "term").select(
        "phrase", "length", "doc_id", "text_hash", (F.col("place") - F.col(f"offset{nth}")).alias("start"), *columns)


def phrase_matches(index: Index) -> DataFrame:
    """(phrase, length, doc_id, text_hash, start): every exact occurrence of every window; ``start`` counts words."""
    first = _lists(index, 1, "near", "at", F.col("term2").isNull().alias("alone")).where("start >= 0")
    same = _lower(F.array_join(F.slice("near", F.col("start") - F.col("at") + 1, F.col("length")), " ")) == F.col("phrase")
    inside = (F.col("start") >= F.col("at")) & (F.col("start") + F.col("length") <= F.col("at") + F.size("near"))
    second = _lists(index, 2).where("start >= 0").selectExpr(
        "phrase AS phrase2", "doc_id AS doc2", "text_hash AS hash2", "start AS start2")
    both = first.where("NOT alone").join(second, F.expr(
        "phrase = phrase2 AND text_hash = hash2 AND start = start2 AND doc_id <=> doc2"), "left_semi")
    return both.union(first.where("alone")).where(inside & same).select(
        "phrase", "length", "doc_id", "text_hash", "start").distinct()


def proximity_matches(index: Index, slop: int = 5) -> DataFrame:
    """(phrase, doc_id, text_hash, start, apart): the two rarest terms of a window in one text, displaced against each
    other by ``apart`` words, at most ``slop``; 0 where they stand as in the window. Places are met in blocks of
    ``slop`` + 1 words and their neighbours, so lists are never paired whole."""
    block = F.floor(F.col("start") / (slop + 1))
    first = _lists(index, 1).withColumn("block", block)
    second = _lists(index, 2).withColumn("block", F.explode(F.array(block - 1, block, block + 1))).select(
        F.col("phrase").alias("phrase2"), F.col("doc_id").alias("doc2"), F.col("text_hash").alias("hash2"),
        F.col("start").alias("start2"), F.col("block").alias("block2"))
    apart = F.abs(F.col("start2") - F.col("start"))
    met = first.join(second, F.expr(
        f"phrase = phrase2 AND text_hash = hash2 AND doc_id <=> doc2 AND block = block2 AND abs(start2 - start) <= {slop}"))
    return met.groupBy("phrase", "doc_id", "text_hash", "start").agg(F.min(apart).alias("apart"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items (items with occurring windows),
    items_sha256 (their ids, sorted as strings, joined by commas) and contaminated (some hit, and one word in ``share``
    at least); ``text_hash`` tells rows of one doc_id apart.

    Every row of ``docs`` gives one. Null or empty texts have no words and no hits; rows alike in doc_id and text get
    the same result; a null doc_id is a value of its own. An empty benchmark contaminates nothing.
    """
    index = build_index(docs, benchmark, window)
    matches = settled(phrase_matches(index))
    hit = (
        matches.select("doc_id", "text_hash", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word"))
        .distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    )
    held = (
        matches.select("doc_id", "text_hash", "phrase").distinct().join(index.items.select("item_id", "phrase"), "phrase")
        .select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id", "text_hash").agg(  # an item once
            F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids"))
    )
    hit = hit.selectExpr("doc_id AS hit_id", "text_hash AS hit_hash", "n_hit")
    held = held.selectExpr("doc_id AS held_id", "text_hash AS held_hash", "n_items", "ids")
    joined = (
        index.docs.join(hit, F.expr("doc_id <=> hit_id AND text_hash = hit_hash"), "left")
        .join(held, F.expr("doc_id <=> held_id AND text_hash = held_hash"), "left")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0))})
    )
    return joined.select(
        "doc_id", "text_hash", "n_words", "n_hit", "n_items",
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words").alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return without_rows(docs, contamination(docs, benchmark, window, share).where("contaminated"), BROADCAST_ROWS)
