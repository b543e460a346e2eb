"""Result files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, directory: str | None = None) -> str:
    """A fresh path under ``directory``, the session's checkpoint directory or, on one machine, its warehouse."""
    base = directory or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a directory that all executors share, or set spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/bidstrata-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def with_row_index(
    df: DataFrame, order: Sequence[str], name: str = "row_index", directory: str | None = None, path: str | None = None
) -> DataFrame:
    """Number rows 0, 1, 2, … in global ``order`` without bringing them into one task.

    Runs a job: the sorted rows are written to ``path`` (a fresh one under ``directory`` if not given), then every
    partition adds the number of rows in the partitions before it. The files fix which rows a partition holds: a range
    sort run again may cut elsewhere. They must outlive the result; ``write_result`` removes them.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, directory)
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    # monotonically_increasing_id: the partition number in the upper bits, the row's place in the lower 33.
    placed = spark.read.parquet(path).withColumns({
        "_part": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_nth"))
        .drop("_id", "_part", "_nth", "_start")
    )


def write_result(
    df: DataFrame, path: str, order: Sequence[str] = (), index: str | None = None, directory: str | None = None
) -> None:
    """Write a CSV with a header, sorted by ``order`` if given; ``index`` names a leading row-number column, for which
    the sorted rows are kept under ``directory`` meanwhile."""
    if index:
        spark = df.sparkSession
        held = scratch_path(spark, directory)
        numbered = with_row_index(df, order, index, path=held).select(index, *df.columns)
        numbered.sortWithinPartitions(index).write.mode("overwrite").csv(path, header=True)
        remove_path(spark, held)
        return
    if order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").csv(path, header=True)
