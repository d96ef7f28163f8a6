"""Registered queries against their SQL twins. TABLEPROBE_ALL=1 runs all of them."""

import math
import os

import duckdb
import pytest

from workload.inputs import TABLES
from workload.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
QUICK = ("column_profile", "top_values", "categorical_stats", "issue_examples", "correlation",
         "cleaned_rows", "join_plan", "combined_decision", "redacted_text", "masked_url",
         "masked_map", "masked_connection", "parsed_values", "json_records", "json_source",
         "csv_source", "read_only_queries", "head_values")
NAMES = list(QUERIES) if os.environ.get("TABLEPROBE_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v.is_integer() else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    assert got[1]
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        assert got == table([c[0] for c in found.description], found.fetchall())


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
