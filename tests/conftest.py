import os
import sys
from datetime import date, datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cut(monkeypatch):
    """Cut every group of more than three rows into slices, as only oversized ones are otherwise."""
    from bidstrata.operators import slicing

    monkeypatch.setattr(slicing, "SPLIT_ROWS", 3)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def on(text: str) -> date:
    return date.fromisoformat(text)


def rows(df, *cols):
    """Rows as a sorted list of tuples, optionally of some columns."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
