"""Input tables of the workload. Views are one text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableprobe import Dataset

# The driver's tables and their columns.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Faults planted into orders, so that every quality check has something to find.
DIRTY = """
SELECT o_orderkey, o_custkey AS customer_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS amount_outlier,
  CASE o_orderkey % 20 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN NULL
    WHEN 3 THEN lower(o_orderpriority) WHEN 4 THEN concat(' ', o_orderpriority, '  ')
    ELSE o_orderpriority END AS priority_txt,
  CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN cast(o_custkey AS string)
    WHEN 2 THEN '2024-01-15' WHEN 3 THEN 'yes' ELSE 'free text' END AS mixed_txt,
  CASE o_orderkey % 8 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '15/03/2024'
    ELSE '2024-03-15' END AS created_txt,
  'X' AS constant_col,
  CASE WHEN o_orderkey % 50 = 0 THEN 'rare' ELSE 'common' END AS near_constant_col,
  concat('user', cast(o_custkey AS string), '@example.com') AS contact,
  CASE WHEN o_orderkey % 33 = 0 THEN 'S�o' ELSE 'Sao' END AS city,
  CASE WHEN o_orderkey % 4 = 0 THEN 'yes' ELSE 'no' END AS churn
FROM orders
"""
DIRTY_COLUMNS = (
    "o_orderkey bigint, customer_id bigint, amount double, amount_outlier double, "
    "priority_txt string, mixed_txt string, created_txt string, constant_col string, "
    "near_constant_col string, contact string, city string, churn string"
)
DIRTY_DUP = f"SELECT * FROM ({DIRTY}) a UNION ALL SELECT * FROM ({DIRTY}) b WHERE o_orderkey % 101 = 0"
DIRTY_EMPTY = """
SELECT CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_custkey END AS a,
  CASE WHEN o_orderkey % 25 = 0 THEN ' ' ELSE o_orderstatus END AS b
FROM orders
"""


def columns_of(text: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in text.split(",")]


def short(table: str, column: str) -> str:
    """Column names of the star tables without their prefix, so that tables share names."""
    return column.split("_", 1)[1] if table in STAR else column


def shortened(table: str) -> str:
    columns = ", ".join(f"{c} AS {short(table, c)}" for c, _ in columns_of(TABLES[table]))
    return f"SELECT {columns} FROM {table}"


# Name, SQL text and columns of every input.
INPUTS: dict[str, tuple[str, str]] = {
    **{t: (shortened(t), ", ".join(f"{short(t, c)} {k}" for c, k in columns_of(s)))
       for t, s in TABLES.items()},
    "dirty": (DIRTY, DIRTY_COLUMNS),
    "dirty_dup": (DIRTY_DUP, DIRTY_COLUMNS),
    "dirty_empty": (DIRTY_EMPTY, "a bigint, b string"),
}
ALL = tuple(TABLES)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dataset(spark: SparkSession, folder: str, name: str) -> Dataset:
    """The input as a dataset, its SQL text run over the Parquet tables."""
    table = name if name in TABLES else "orders"
    sql = INPUTS[name][0].replace(f"FROM {table}", "FROM {source}")
    return Dataset(name, spark.sql(sql, source=read(spark, folder, table)))
