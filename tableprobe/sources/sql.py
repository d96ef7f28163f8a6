"""SQL tables and queries as datasets, behind a read-only check."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tableprobe.dataset import Dataset
from tableprobe.functions.wordlists import MUTATING_WORDS
from tableprobe.staging import Stage

TABLE_NAME = r"^[A-Za-z_][A-Za-z0-9_.]*$"
READING = r"^\s*(select|with)\b"
MUTATING = r"\b(" + "|".join(MUTATING_WORDS) + r")\b"


def is_read_only(c: str) -> str:
    """Expression: a text starts as a reading query and holds no mutating word."""
    return f"({c} RLIKE r'(?i){READING}' AND NOT {c} RLIKE r'(?i){MUTATING}')"


def check_query(query: str) -> str:
    query = query.strip().rstrip(";")
    if not re.match(READING, query, re.IGNORECASE) or re.search(MUTATING, query, re.IGNORECASE):
        raise ValueError("only SELECT or WITH queries without mutating words are read")
    return query


def check_table(table: str) -> str:
    if not re.match(TABLE_NAME, table):
        raise ValueError(f"not a plain table name: {table!r}")
    return table


def load_sql(
    spark: SparkSession, table: str | None = None, query: str | None = None,
    limit: int | None = None, url: str | None = None, properties: dict | None = None,
) -> Dataset:
    """All rows of a table or query, over JDBC if a url is given, else of the catalog.

    With a `limit` so many rows at most, whichever the source gives first; they are staged, so that all
    figures are of the same rows, and `truncated` in the metadata says whether there were more.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    wanted = check_table(table) if table else check_query(query)
    if url:
        reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
        df = reader.option("dbtable" if table else "query", wanted).load()
    else:
        df = spark.table(wanted) if table else spark.sql(wanted)
    truncated = False
    if limit is not None:
        # What a limit gives is one partition, whose rows are numbered from 0; one more tells if it cuts.
        rows = df.limit(limit + 1).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"))
        rows = Stage(spark).table("rows", lambda: rows)
        truncated = not rows.where(F.col("number") >= limit).isEmpty()
        df = rows.where(F.col("number") < limit).select("row.*")
    source = {"type": "sql", "table": table, "limit": limit}
    return Dataset(table or "query", df, source, {"query": query, "truncated": truncated})
