"""Every query outside the optional subpackage gives the rows of its SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from capsight.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in found.collect()]
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert _sorted(rows) == _sorted(expected)
