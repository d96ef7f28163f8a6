"""Row-level checks: duplicates, empty rows, previews and example rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.dataset import TEXT, ColumnRef, Dataset, text_form
from tableprobe.functions import text
from tableprobe.functions.safe import json_row
from tableprobe.functions.sql import literal, quote, records

ISSUE_EXAMPLES = 5

#: A preview is ordered by so many columns.
SORTED = 3

#: Columns whose nulls one mask tells.
MASKED = 60


def _hashable(df: DataFrame) -> list[str]:
    """Columns to fingerprint. Maps become sorted entries since they have no hash; a null leaves a hash as it
    was, so masks of nulls come first, and nested values are read as JSON that shows theirs."""
    nested = "map('ignoreNullFields', 'false')"
    columns = []
    for f in df.schema.fields:
        value = quote(f.name)
        if isinstance(f.dataType, T.MapType):
            value = f"array_sort(map_entries({value}))"
        if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            value = f"to_json(struct({value} AS v), {nested})"
        elif isinstance(f.dataType, T.VariantType):
            value = f"to_json({value})"
        columns.append(value)
    masks = []
    for start in range(0, len(columns), MASKED):
        bits = (f"CASE WHEN {quote(f.name)} IS NULL THEN {1 << k}L ELSE 0L END"
                for k, f in enumerate(df.schema.fields[start:start + MASKED]))
        masks.append(" + ".join(bits))
    return [*masks, *columns]


def first_print(values: list[str]) -> str:
    return f"xxhash64({', '.join(values)})"


def second_print(values: list[str]) -> str:
    """Another 64 bits, from another start and the other way round."""
    return f"xxhash64({', '.join(['7919', *reversed(values)])})"


def _prints(df: DataFrame, number: int) -> DataFrame:
    values = _hashable(df)
    return df.selectExpr(
        f"{number} AS dataset_no", f"{first_print(values)} AS row_print", f"{second_print(values)} AS other_print")


def repeated_prints(datasets: list[Dataset]) -> DataFrame:
    """dataset_no, row_print, n, agreed: 64-bit fingerprints of rows that occur more than once, and whether
    all these rows agree in 64 further bits.

    All that is shuffled of a row is its fingerprints, one row for each and task.
    """
    return reduce(DataFrame.union, [
        _prints(d.df, n) for n, d in enumerate(datasets) if d.df.columns
    ]).groupBy("dataset_no", "row_print").agg(
        F.expr("count(1) AS n"), F.expr("min(other_print) = max(other_print) AS agreed")).where("n > 1")


def duplicate_counts(datasets: list[Dataset], prints: DataFrame) -> DataFrame:
    """dataset_no, duplicate_rows: every member of a group of equal rows counts, nulls are equal.

    Rows count as equal where 128 bits of them are. Of prints whose rows differ in the second half the
    rows are read again, as prints, and grouped by both halves; tables without any are not read again.
    """
    spark = prints.sparkSession
    counted = prints.where("agreed").groupBy("dataset_no").agg(F.expr("sum(n) AS duplicate_rows"))
    collided = prints.where("NOT agreed").select("dataset_no", "row_print")
    again = sorted(r["dataset_no"] for r in collided.select("dataset_no").distinct().collect())
    for number in again:
        own = collided.where(f"dataset_no = {number}").select("row_print")
        pairs = _prints(datasets[number].df, number).join(own, "row_print", "left_semi").groupBy(
            "dataset_no", "row_print", "other_print").agg(F.expr("count(1) AS n")).where("n > 1")
        counted = counted.union(pairs.groupBy("dataset_no").agg(F.expr("sum(n) AS duplicate_rows")))
    every = spark.range(len(datasets)).selectExpr("int(id) AS dataset_no", "0L AS duplicate_rows")
    return every.union(counted).groupBy("dataset_no").agg(F.expr("sum(duplicate_rows) AS duplicate_rows"))


def empty_rows(datasets: list[Dataset], refs: list[ColumnRef], metrics: DataFrame) -> DataFrame:
    """dataset_no, rows_fully_empty: rows in which every value is null or a blank text.

    There can be no such row where some column is always filled, so the metrics, one figure per
    table, decide which tables are read at all.
    """
    spark = metrics.sparkSession
    gaps = f"""row_count - non_null
        + CASE WHEN kind = 'text' THEN code{text.EMPTY} + code{text.BLANK} ELSE 0 END"""
    suspects = {
        r["dataset_no"] for r in metrics.groupBy("dataset_no")
        .agg(F.expr(f"min({gaps}) AS gaps")).where("gaps > 0").collect()
    }
    parts = []
    for number, dataset in enumerate(datasets):
        if number in suspects:
            own = sorted((r for r in refs if r.dataset_no == number), key=lambda r: r.kind == TEXT)
            tests = (
                f"coalesce({text.is_blank(r.sql)}, true)" if r.kind == TEXT
                else f"{r.sql} IS NULL" for r in own
            )
            counted = dataset.df.where(" AND ".join(tests)).agg(
                F.expr("count(1) AS rows_fully_empty"))
        else:
            counted = spark.range(1).selectExpr("0L AS rows_fully_empty")
        parts.append(counted.selectExpr(f"{number} AS dataset_no", "rows_fully_empty"))
    return reduce(DataFrame.union, parts)


def sample_rows(dataset: Dataset, order_by: list[str], limit: int = 8) -> DataFrame:
    """The first rows by a key, which must be given since a table has no order of its own."""
    return dataset.df.orderBy(*[quote(c) for c in order_by]).limit(limit)


def preview(datasets: list[Dataset], limit: int = 8) -> DataFrame:
    """dataset, rank, record: the first rows of every table by its columns, as JSON texts.

    The rank filter works before the shuffle. Columns without an order (maps, variants) do not count.
    """
    parts = []
    for d in datasets:
        order = [quote(f.name) for f in d.df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        first = d.df.orderBy(*order[:SORTED]).limit(limit) if order else d.df.limit(limit)
        parts.append(first.selectExpr(f"{literal(d.name)} AS dataset", f"{json_row(first.schema)} AS record"))
    return reduce(DataFrame.union, parts).selectExpr(
        "dataset", "row_number() OVER (PARTITION BY dataset ORDER BY record) AS rank", "record")


def head_values(
    dataset: Dataset, refs: list[ColumnRef], order_by: str, limit: int
) -> DataFrame:
    """column, rank, value: the first non-null values of every column as texts, by a key.

    The rank filter works before the shuffle, so only a few rows per task travel.
    """
    cells = records(
        {"column": literal(r.name), "value": text_form(r)} for r in refs if r.dtype != "void")
    values = dataset.df.selectExpr(f"{quote(order_by)} AS row_key", f"inline({cells})")
    return values.where("value IS NOT NULL").selectExpr(
        "column", "row_number() OVER (PARTITION BY column ORDER BY row_key, value) AS rank", "value"
    ).where(f"rank <= {limit}")


def issue_examples(
    dataset: Dataset, refs: list[ColumnRef], bounds: DataFrame, key: str,
    limit: int = ISSUE_EXAMPLES,
) -> DataFrame:
    """dataset, column, type, rank, row_key, value: the first rows by key that show an issue."""
    cells = records(
        {
            "cid": str(r.cid), "column": literal(r.name), "missing": f"{r.sql} IS NULL",
            "text_value": f"string({r.sql})" if r.kind == TEXT else "cast(null AS string)",
            "number": f"double({r.sql})" if r.numeric else "cast(null AS double)",
        }
        for r in refs
    )
    found = (
        dataset.df.selectExpr(f"{quote(key)} AS row_key", f"inline({cells})")
        .join(F.broadcast(bounds.select("cid", "lower_bound", "upper_bound")), "cid", "left")
        .selectExpr(
            "row_key", "column", "coalesce(text_value, string(number)) AS value",
            f"CASE WHEN missing THEN 'missing_values' WHEN {text.is_blank('text_value')} "
            "THEN 'blank_strings' WHEN number < lower_bound OR number > upper_bound "
            "THEN 'numeric_outliers' END AS type",
        )
        .where("type IS NOT NULL")
    )
    return found.selectExpr(
        f"{literal(dataset.name)} AS dataset", "column", "type",
        "row_number() OVER (PARTITION BY column, type ORDER BY row_key) AS rank", "row_key", "value",
    ).where(f"rank <= {limit}")
