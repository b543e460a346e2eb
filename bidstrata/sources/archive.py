"""Readers for the operator's archive CSVs and the unit map, and their ingest to Parquet.

An archive file has four line types, told apart by the first cell: C (first and last line), I (column names)
and D (data). Keeping the D lines needs no line skipping, so files split freely and a path glob reads every part
of a table as one. Parts may differ in layout, as the layout changes over the years: the I line of each file says
where its columns are.

A data line that does not have a cell for each of its file's columns is no data: ``read_archive`` leaves it out,
``quarantine`` lists it, and ``check_footer`` counts it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstrata.functions.periods import expand_periods, market_time
from bidstrata.operators.joins import align_detail
from bidstrata.schema import AUCTION, LINE_PREFIX, TABLES

PART_GLOB = "FILE*.[cC][sS][vV]"
#: Where the reader puts the text of a line whose cells do not fit the columns.
_MISFIT = "_misfit"
#: A comma that an even number of quotes follows, which is one outside quoted cells.
_CELL_END = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


#: Rows to a bucket of a table.
BUCKET_ROWS = 500_000


def parts(directory: str, table: str) -> str:
    """Glob over every part file of a table in a directory of archives."""
    return f"{directory}/*#{table}#{PART_GLOB}"


def _lines(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` STRING" for c in [*LINE_PREFIX, *columns, _MISFIT])
    # The parser would count the cells of the columns wanted only, and no line would be a misfit.
    return spark.read.schema(schema).options(
        quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_MISFIT, columnPruning=False).csv(path)


def _typed(name: str, kind: str) -> Column:
    text = F.col(name)
    if kind == "string":
        return text
    if kind == "upper":
        return F.upper(text).alias(name)
    if kind == "timestamp_ntz":
        return market_time(text).alias(name)
    if kind == "date":
        return F.to_date(market_time(text)).alias(name)
    return text.try_cast(kind).alias(name)


def layouts(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names, from the I line of each; one pass over the text, a line per file to the driver."""
    heads = spark.read.text(path).where(F.col("value").startswith("I,")).groupBy(
        F.col("_metadata.file_path").alias("file")).agg(F.collect_set("value").alias("lines"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in heads.orderBy("file").collect():
        if len(r["lines"]) > 1:
            raise ValueError(f"several column-name lines in {r['file']}")
        names = tuple(c.strip().strip('"') for c in r["lines"][0].split(",")[len(LINE_PREFIX):])
        found.setdefault(names, []).append(unquote(r["file"]))
    if not found:
        raise ValueError(f"no column-name line in {path}")
    return found


def _data(
    spark: SparkSession, path: str | Sequence[str], table: str, columns: Sequence[tuple[str, str]] | None
) -> list[tuple[DataFrame, list[tuple[str, str]]]]:
    """Data lines of the files of each layout as text, misfits and all, and the (name, type) list of what they have."""
    out = []
    for names, files in layouts(spark, path).items():
        if columns is not None and names != tuple(c for c, _ in columns):
            raise ValueError(f"{files[0]} has other columns than given: {', '.join(names)}")
        declared = columns or TABLES.get(table) or [(c, "string") for c in names]
        lines = _lines(spark, files, names).where(F.col("REC") == "D")
        out.append((lines, [(c, kind) for c, kind in declared if c in names]))
    return out


def read_archive(
    spark: SparkSession, path: str | Sequence[str], table: str, columns: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Data rows of an archive table with declared types; cells that do not parse are null, and lines with more or fewer cells
    than columns are left out (``quarantine``).

    Columns are found by each file's own I line and typed by the registry entry of ``table``; a table the registry
    lacks comes as strings. A column that some files lack is null in their rows. ``columns`` gives the (name, type) list
    in file order instead; a file that disagrees is an error.
    """
    parts_read = [
        rows.where(F.col(_MISFIT).isNull()).select(*[_typed(*c) for c in wanted]) for rows, wanted in _data(spark, path, table, columns)]
    whole = parts_read[0]
    for more in parts_read[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    rank = {c: k for k, (c, _) in enumerate(columns or TABLES.get(table, []))}
    return whole.select(*sorted(whole.columns, key=lambda c: rank.get(c, len(rank))))


def rejected_cells(
    spark: SparkSession, path: str | Sequence[str], table: str, columns: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Number of non-empty cells per column that ``read_archive`` turns into null."""
    lost = None
    for raw, wanted in _data(spark, path, table, columns):
        typed = [c for c in wanted if c[1] not in ("string", "upper")]
        if not typed:
            continue
        counts = raw.where(F.col(_MISFIT).isNull()).agg(*[F.count_if(F.col(n).isNotNull() & _typed(n, k).isNull()).alias(n) for n, k in typed])
        counts = counts.unpivot([], [n for n, _ in typed], "column_name", "rejected")
        lost = counts if lost is None else lost.union(counts)
    if lost is None:
        return spark.createDataFrame([], "column_name string, rejected bigint")
    return lost.groupBy("column_name").agg(F.sum("rejected").alias("rejected"))


def quarantine(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line, cells, columns, reason): the lines that ``read_archive`` does not take for data though they are no frame
    lines: data lines with ``surplus cells`` or ``missing cells`` against their file's column names, or an ``open quote`` (``cells`` null), lines of
    an ``unknown type``, and data lines of files with ``no column names``. An archive without any gives no rows.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    named = text.where(F.col("line").startswith("I,")).select("file").distinct()
    found = text.where(F.col("line").startswith("D,")).join(named, "file", "left_anti").select(
        "file", "line", F.size(F.split("line", _CELL_END)).alias("cells"), F.lit(None).cast("int").alias("columns"),
        F.lit("no column names").alias("reason"))
    for names, files in layouts(spark, path).items():
        wide = len(LINE_PREFIX) + len(names)
        raw = _lines(spark, files, names)
        # Read as text beside its cells, a line that fits has no text: only misfits and odd types carry theirs.
        odd = raw.where(
            ~F.coalesce(F.col("REC").isin("C", "I", "D"), F.lit(False)) | ((F.col("REC") == "D") & F.col(_MISFIT).isNotNull()))
        line = F.coalesce(F.col(_MISFIT), F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in (*LINE_PREFIX, *names)]))
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        cells = F.when(quotes % 2 == 0, F.size(F.split(line, _CELL_END)))
        reason = (
            F.when(F.coalesce(F.col("REC"), F.lit("")) != "D", "unknown type").when(quotes % 2 == 1, "open quote")
            .when(cells > wide, "surplus cells").otherwise("missing cells"))
        found = found.unionByName(odd.select(
            F.col("_metadata.file_path").alias("file"), line.alias("line"), cells.alias("cells"), F.lit(wide).alias("columns"),
            reason.alias("reason")))
    return found


def check_footer(spark: SparkSession, path: str | Sequence[str], extra_lines: int = 3) -> DataFrame:
    """Per file, by its full path: its data lines, those of them that ``quarantine`` lists, the footer's line count, and
    whether the file is ``complete``: the footer counts as many lines as there are, none of them in quarantine.

    The footer line is ``C,END OF REPORT,<n>``; ``extra_lines`` is how many lines besides data rows it counts
    (first line, column names and footer: 3).
    """
    footer = (F.col("REC") == "C") & (F.col("PACKAGE") == "END OF REPORT")
    per_file = _lines(spark, path, []).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count_if(F.col("REC") == "D").alias("data_rows"),
        F.max(F.when(footer, F.col("TABLENAME").try_cast("bigint"))).alias("footer_lines"))
    bad = quarantine(spark, path).groupBy("file").agg(F.count("*").alias("quarantined"))
    agrees = (F.col("data_rows") + extra_lines == F.col("footer_lines")) & (F.col("quarantined") == 0)
    return per_file.join(bad, "file", "left").fillna(0, ["quarantined"]).select(
        "file", "data_rows", "quarantined", "footer_lines", F.coalesce(agrees, F.lit(False)).alias("complete"))


def read_unit_map(spark: SparkSession, path: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """The unit map: plain CSV with a header. ``renames`` maps the file's flag column to AUTOBIDDER."""
    units = spark.read.csv(path, header=True).withColumnsRenamed(dict(renames or {}))
    return units.select(
        "DUID", "DISPATCHTYPE", F.lower("AUTOBIDDER").try_cast("boolean").alias("AUTOBIDDER"), "PARTICIPANT_NAME"
    )


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def ingest(
    df: DataFrame, dst: str, day: str = "SETTLEMENTDATE", sort: Sequence[str] = ("DUID", "BIDTYPE"), bloom: Sequence[str] = ("DUID",),
) -> None:
    """Write typed rows to Parquet, a directory per market day, so that later jobs prune days and columns.

    Rows go out spread over the sort columns as well as the day: one day's file set has many writers, and each
    file holds a narrow range of units, which makes its row-group statistics useful. Days present in ``df``
    replace those at ``dst``; other days stay, so months can be ingested one after another or again. Columns of ``bloom`` that
    the table has get Bloom filters, which tell a reader of a few units the row groups without them where ranges do not.
    """
    # The row's hash comes last among the range columns, so that even one unit's day and service can be divided.
    spread = df.withColumn("market_day", F.to_date(day)).repartitionByRange(
        "market_day", *sort, F.xxhash64(*df.columns))
    writer = spread.sortWithinPartitions("market_day", *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    for c in bloom:
        if c in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy("market_day").parquet(dst)


def ingest_detail(df: DataFrame, dst: str) -> None:
    """``ingest`` of quantity detail as the archive has it: names aligned to the header table, and a row per period
    where one row covers several."""
    ingest(expand_periods(align_detail(df)), dst)


def buckets_for(df: DataFrame, least: int = 1) -> int:
    """How many buckets keep a bucket of ``df`` at about ``BUCKET_ROWS`` rows, so that tasks which read or write one need no
    more memory as tables grow. Counts the rows; give the table as read, whose files know their number."""
    return max(least, -(-df.count() // BUCKET_ROWS))


def ingest_together(
    df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = AUCTION, order: Sequence[str] = (),
) -> None:
    """Write typed rows as the catalogue's ``table`` under ``path``, rows of equal ``keys`` in one of ``buckets`` files, sorted
    by keys and ``order``.

    Tables written with the same keys and number of buckets meet where they lie: a window over the keys, or over these and
    more, needs no exchange (``split_rows=slicing.WHOLE``), and neither does a join on them (``join_in_place``). All rows of
    a key are one task's then, so this is for keys of ordinary size; ``ingest`` spreads any.
    """
    (
        df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table)
    )


def join_in_place(spark: SparkSession) -> None:
    """Let this session join tables on more columns than they are partitioned by without exchanging them again: a panel's
    price and quantity side share an auction's bucket and are joined on the offer time as well."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
