"""Every registered query against its DuckDB SQL on the smallest fixture (driver-style compare)."""
import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import compare


def test_all_registered_queries_match_sql(spark):
    res = compare(spark, SF_SMALL)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 100
    assert set(E.oracle_sql()) <= set(E.queries())
