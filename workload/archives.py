"""Writes the driver's tables out in the archive's line format, so that the readers have files to read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Types whose text holds no comma.
PLAIN = ("int", "bigint", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def write_archive(df: DataFrame, table: str, columns: Sequence[str], path: str) -> None:
    """Every partition that has rows as one archive file, compressed: first line, column names, data rows, footer with the
    line count. Lines stream through the partition's task, which counts them; no row leaves it."""
    kinds = dict(df.dtypes)

    def quoted(name: str):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return text if kinds[name] in PLAIN else F.when(text.contains(","), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)

    head = [f"C,BIDS,{table},PUBLIC", ",".join(["I", "BIDS", table, "1", *columns])]

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            if not rows and batch.num_rows:
                yield pa.RecordBatch.from_pydict({"value": head}, batch.schema)
            rows += batch.num_rows
            yield batch
        if rows:
            yield pa.RecordBatch.from_pydict({"value": [f"C,END OF REPORT,{rows + 3}"]}, batch.schema)

    cells = [F.lit("D"), F.lit("BIDS"), F.lit(table), F.lit("1"), *[quoted(c) for c in columns]]
    lines = df.select(F.concat_ws(",", *cells).alias("value")).mapInArrow(framed, "value string")
    lines.write.option("compression", "lz4").text(path)
