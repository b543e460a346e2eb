import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_query_has_its_sql():
    """All but those of the text operators, some of which SQL cannot state."""
    own = set(entry.queries()) - set(entry.TEXT_QUERIES)
    assert own <= set(entry.oracle_sql()) and len(own) > 80
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["bidder_category", "n", "mean", "median", "std", "max", "pct_zero"]
    assert df.count() == 3


def test_the_rest_stands_where_the_text_operators_cannot_be_imported():
    code = ("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.TEXT_QUERIES), len(e.TEXT_ORACLES))")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    own = len(set(entry.queries()) - set(entry.TEXT_QUERIES))
    assert done.stdout.split() == [str(own), "0", "0"], done.stderr[-500:]
