"""Every registered query against DuckDB on the smallest tables."""

from collections import Counter
from decimal import Decimal

import pytest
from tables import DATA

from tidemark.plans.registry import ORACLE, QUERIES


def plain(value):
    if isinstance(value, float):
        return round(value, 4)
    if isinstance(value, Decimal):
        return int(value) if value == int(value) else float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
