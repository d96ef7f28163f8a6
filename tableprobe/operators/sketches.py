"""Approximate figures for tables too large to shuffle every value.

Distinct counts, quartiles and the share of the most frequent value come from mergeable sketches
in one scan per kind of column. A second scan counts the numbers outside the bounds exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.dataset import (
    BOOLEAN, DATE, OTHER, REAL, TEXT, WHOLE, ColumnRef, Dataset, text_form,
)
from tableprobe.functions import text
from tableprobe.operators.metrics import long_form

DISTINCT_ERROR = 0.02
RANK_ACCURACY = 1_000
TOP_ITEMS = 5
TOP_TRACKED = 1_000


def _distinct(value: str) -> str:
    return f"approx_count_distinct({value}, {DISTINCT_ERROR})"


def _branches(datasets: list[Dataset], refs: list[ColumnRef]):
    """Long forms by kind. Whole numbers keep their type, since not all have a double of their own."""
    for kinds, key in (
        ((WHOLE,), lambda r: f"cast({r.sql} AS bigint)"),
        ((REAL,), lambda r: f"cast({r.sql} AS double)"),
        ((DATE, BOOLEAN), text_form),
        ((TEXT, OTHER), lambda r: text.frequency_key(text_form(r))),
    ):
        values = long_form(datasets, [r for r in refs if r.kind in kinds], key)
        if values is not None:
            yield kinds, values


def distinct_counts(datasets: list[Dataset], refs: list[ColumnRef]) -> DataFrame:
    """cid, distinct_values. A column has no more values than rows, whatever the sketch says."""
    return reduce(DataFrame.union, [
        values.groupBy("cid").agg(F.expr(f"least({_distinct('v')}, count(1)) AS distinct_values"))
        for _, values in _branches(datasets, refs)
    ])


def value_sketches(datasets: list[Dataset], refs: list[ColumnRef]) -> DataFrame:
    """cid, top_count, distinct_normalised, q1, median, q3."""
    # The sketch drops rare values; one that dominates a column is always kept.
    top = f"coalesce(get(approx_top_k(v, {TOP_ITEMS}, {TOP_TRACKED}), 0).count, 0L) AS top_count"
    parts = []
    for kinds, values in _branches(datasets, refs):
        quarters, normalised = "cast(null AS array<double>)", "cast(null AS bigint)"
        if kinds in ((WHOLE,), (REAL,)):
            quarters = f"percentile_approx(v, array(0.25D, 0.5D, 0.75D), {RANK_ACCURACY})"
        elif TEXT in kinds:
            normalised = f"least({_distinct(text.normalised_key('v'))}, count(1))"
        parts.append(values.groupBy("cid").agg(
            F.expr(top), F.expr(f"{normalised} AS distinct_normalised"), F.expr(f"{quarters} AS q"),
        ).selectExpr("cid", "top_count", "distinct_normalised", "double(get(q, 0)) AS q1",
                     "double(get(q, 1)) AS median", "double(get(q, 2)) AS q3"))
    return reduce(DataFrame.union, parts)


def outliers(datasets: list[Dataset], refs: list[ColumnRef], quarters: DataFrame) -> DataFrame:
    """cid, outlier_count, lower_bound, upper_bound, counted on the rows."""
    numbers = long_form(datasets, [r for r in refs if r.numeric], lambda r: f"double({r.sql})")
    bounds = quarters.where("q3 - q1 != 0").selectExpr(
        "cid", "q1 - 1.5D * (q3 - q1) AS lower_bound", "q3 + 1.5D * (q3 - q1) AS upper_bound")
    if numbers is None:
        return bounds.where("false").selectExpr(
            "cid", "lower_bound", "upper_bound", "0L AS outlier_count")
    # One row of bounds per numeric column.
    return (
        numbers.join(F.broadcast(bounds), "cid").groupBy("cid", "lower_bound", "upper_bound")
        .agg(F.expr("count(1) AS numbers"),
             F.expr("count_if(v < lower_bound OR v > upper_bound) AS outlier_count"))
        .where("numbers >= 8 AND outlier_count > 0").drop("numbers")
    )
