"""Schema section: semantic types, null and distinct figures, flags, type mix, summary."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.dataset import Dataset
from tableprobe.functions import text
from tableprobe.functions.sql import percent, present, rounded, share

PROFILE_COLUMNS = (
    "dataset", "ordinal", "column", "dtype", "semantic_type", "row_count", "null_count",
    "null_pct", "non_null_count", "unique_count", "unique_rate", "possible_sensitive",
)
SEMANTIC_TYPES = ("numeric", "date", "boolean", "categorical", "text", "long_text")


def codes(*wanted: int) -> str:
    return "(" + " + ".join(f"code{code}" for code in wanted) + ")"


TRUTHS = codes(text.TRUTH_NUMBER, text.TRUTH_WORD, text.TRUTH_LETTER)
DAYS = codes(text.DAY_NUMBER, text.DAY)
# Values that are neither null, empty nor white space.
FILLED = codes(*range(text.TRUTH_NUMBER, text.WORDS + 1))

EXACT_UNIQUE_RATE = share("unique_count", "row_count")
MEAN_LENGTH = share("length_filled", FILLED)

SEMANTIC_TYPE = f"""
    CASE WHEN kind IN ('boolean', 'date') THEN kind
         WHEN kind IN ('whole', 'real') THEN 'numeric'
         WHEN kind != 'text' THEN 'categorical'
         WHEN {share(TRUTHS, 'non_null')} >= 0.95 THEN 'boolean'
         WHEN {share(DAYS, 'non_null')} >= 0.8 THEN 'date'
         WHEN {MEAN_LENGTH} > 60 THEN 'long_text'
         WHEN {MEAN_LENGTH} > 24 OR {EXACT_UNIQUE_RATE} > 0.5 THEN 'text'
         ELSE 'categorical' END"""

# Schema flags of a column, in their fixed order.
FLAGS = present((
    "CASE WHEN null_count > 0 THEN 'missing_values' END",
    "CASE WHEN row_count > 0 AND unique_count <= 1 THEN 'constant' END",
    f"CASE WHEN row_count > 5 AND {EXACT_UNIQUE_RATE} > 0.9 THEN 'high_cardinality' END",
    "CASE WHEN possible_sensitive THEN 'possible_sensitive_field' END",
))


def column_facts(metrics: DataFrame, distinct: DataFrame) -> DataFrame:
    """Metrics with the distinct counts, semantic type and sensitivity of every column.

    Null counts as one more distinct value.
    """
    counted = metrics.join(distinct, "cid", "left").selectExpr(
        "*", "row_count - non_null AS null_count",
        "coalesce(distinct_values, 0L) + int(row_count > non_null) AS unique_count",
    )
    return counted.selectExpr(
        "*",
        f"{SEMANTIC_TYPE} AS semantic_type",
        "named_sensitive OR personal_content AS possible_sensitive",
        f"{percent('null_count', 'row_count')} AS null_pct",
        "non_null AS non_null_count",
        f"{rounded(EXACT_UNIQUE_RATE, 4)} AS unique_rate",
    )


def column_profile(facts: DataFrame) -> DataFrame:
    return facts.select(*PROFILE_COLUMNS)


def column_flags(facts: DataFrame) -> DataFrame:
    return facts.selectExpr("dataset", "column", f"explode({FLAGS}) AS flag")


def type_counts(facts: DataFrame) -> DataFrame:
    """Columns per semantic type, and their share of the columns of the dataset."""
    counted = facts.groupBy("dataset", "semantic_type").agg(F.expr("count(1) AS columns"))
    return counted.selectExpr(
        "*", f"{percent('columns', 'sum(columns) OVER (PARTITION BY dataset)')} AS pct")


def dataset_summary(facts: DataFrame, duplicates: DataFrame, empty: DataFrame) -> DataFrame:
    """Rows, cells, nulls, duplicates, empty rows and the mix of types, per dataset."""
    grouped = facts.groupBy("dataset_no", "dataset").agg(*[F.expr(e) for e in (
        "max(row_count) AS row_count", "count(1) AS column_count",
        "sum(row_count) AS total_cells", "sum(null_count) AS null_cells",
        "max(null_pct) AS max_null_pct",
        "count_if(possible_sensitive) AS sensitive_columns",
        *[f"count_if(semantic_type = '{t}') AS {t}_columns" for t in SEMANTIC_TYPES],
    )])
    joined = grouped.join(duplicates, "dataset_no", "left").join(empty, "dataset_no", "left")
    return joined.selectExpr(
        "*", f"{percent('null_cells', 'total_cells')} AS null_pct",
        f"{percent('duplicate_rows', 'row_count')} AS duplicate_pct",
    )


def file_sizes(datasets: list[Dataset]) -> DataFrame:
    """dataset_no, bytes, megabytes: the files a table is read from, null where it is not read from files.

    One row a file is shuffled, whatever files hold; no column is read.
    """
    parts = []
    for number, dataset in enumerate(datasets):
        files = dataset.df.sparkSession.createDataFrame([], "file string, size bigint")
        if dataset.df.inputFiles():
            with suppress(AnalysisException):  # derived from files, but no plain scan of them
                files = dataset.df.selectExpr("_metadata.file_path AS file", "_metadata.file_size AS size")
        parts.append(files.groupBy("file").agg(F.expr("max(size) AS size")).agg(
            F.expr("sum(size) AS bytes")).selectExpr(f"{number} AS dataset_no", "bytes", "round(bytes / 1048576D, 2) AS megabytes"))
    return reduce(DataFrame.union, parts)
