"""Tables behind the charts of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.operators.frequency import DISPLAY, Texts, ranked_values
from tableprobe.operators.statistics import categorical_columns


def _first(df: DataFrame, limit: int, order: str) -> DataFrame:
    return df.selectExpr(
        "*", f"row_number() OVER (PARTITION BY dataset ORDER BY {order}) AS rank"
    ).where("true" if limit is None else f"rank <= {limit}")


def nulls_by_column(facts: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(facts, limit, "null_pct DESC, ordinal").select(
        "dataset", "rank", "column", "null_pct")


def problems_by_column(problems: DataFrame, limit: int | None = None) -> DataFrame:
    counted = problems.groupBy("dataset", "ordinal", "column").agg(F.expr("count(1) AS problems"))
    return _first(counted, limit, "problems DESC, ordinal").select(
        "dataset", "rank", "column", "problems")


def outliers_by_column(quality: DataFrame) -> DataFrame:
    return quality.where("outlier_count IS NOT NULL").select(
        "dataset", "ordinal", "column", "outlier_count")


def categories(
    facts: DataFrame, frequencies: DataFrame, texts: Texts, columns: int | None = None,
    top: int | None = 10,
) -> DataFrame:
    """Top values of the first categorical columns, of all for None."""
    chosen = _first(categorical_columns(facts), columns, "ordinal").select(
        "cid", "dataset", "ordinal", "column")
    own = frequencies.join(F.broadcast(chosen), "cid")
    return ranked_values(own, texts, top).selectExpr(
        "dataset", "ordinal", "column", "rank", f"{DISPLAY} AS value", "cnt")


def datasets(summary: DataFrame, problems: DataFrame) -> DataFrame:
    counted = problems.groupBy("dataset_no").agg(F.expr("count(1) AS n"))
    return summary.join(counted, "dataset_no", "left").selectExpr(
        "dataset", "row_count", "null_pct", "coalesce(n, 0L) AS problems")


def shared_columns(common: DataFrame, limit: int | None = None) -> DataFrame:
    named = common.select("name", "refs")
    return named if limit is None else named.orderBy("name").limit(limit)
