"""Exact order statistics of every numeric column, without a single-task sort.

The distinct numbers are range-partitioned by (column, value) and staged. Totals per partition
and column say which partition holds a wanted rank; only there is a running count needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.sql import records


def ranged_numbers(frequencies: DataFrame) -> DataFrame:
    """cid, num, cnt, slice: sorted slices of the numeric values. To be staged before use."""
    return (
        frequencies.where("num IS NOT NULL").select("cid", "num", "cnt")
        .repartitionByRange("cid", "num").sortWithinPartitions("cid", "num")
        .withColumn("slice", F.spark_partition_id())
    )


def slice_totals(ranged: DataFrame) -> DataFrame:
    """cid, slice, held, before, n: one row per column and slice, small whatever the data."""
    return ranged.groupBy("cid", "slice").agg(F.expr("sum(cnt) AS held")).selectExpr(
        "*",
        "sum(held) OVER (PARTITION BY cid ORDER BY slice) - held AS before",
        "sum(held) OVER (PARTITION BY cid) AS n",
    )


def quartiles(ranged: DataFrame, totals: DataFrame) -> DataFrame:
    """cid, q1, median, q3: nearest-rank quartiles and the median as a mean of middle ranks."""
    ranks = records((
        {"what": "'q1'", "rank": "floor((n - 1) * 0.25D + 0.5D)"},
        {"what": "'low'", "rank": "floor((n - 1) / 2)"},
        {"what": "'high'", "rank": "ceil((n - 1) / 2)"},
        {"what": "'q3'", "rank": "floor((n - 1) * 0.75D + 0.5D)"},
    ))
    # At most four places per column, so the broadcasts are bounded by the width of the tables.
    places = F.broadcast(
        totals.selectExpr("cid", "slice", "held", "before", f"inline({ranks})")
        .where("rank >= before AND rank < before + held")
        .selectExpr("cid", "slice", "what", "rank - before AS place")
    )
    counted = ranged.join(places, ["cid", "slice"], "left_semi").selectExpr(
        "cid", "slice", "num", "cnt",
        "sum(cnt) OVER (PARTITION BY cid, slice ORDER BY num ROWS UNBOUNDED PRECEDING) AS upto",
    )
    picked = counted.join(places, ["cid", "slice"]).where("place < upto AND place >= upto - cnt")
    pick = "max(CASE WHEN what = '{}' THEN num END)".format
    return picked.groupBy("cid").agg(
        F.expr(f"{pick('q1')} AS q1"),
        F.expr(f"({pick('low')} + {pick('high')}) / 2 AS median"),
        F.expr(f"{pick('q3')} AS q3"),
    )


def outliers(ranged: DataFrame, quarters: DataFrame) -> DataFrame:
    """cid, outlier_count, lower_bound, upper_bound by the 1.5 interquartile-range rule."""
    bounds = quarters.where("q3 - q1 != 0").selectExpr(
        "cid", "q1 - 1.5D * (q3 - q1) AS lower_bound", "q3 + 1.5D * (q3 - q1) AS upper_bound")
    return (
        ranged.join(F.broadcast(bounds), "cid").groupBy("cid", "lower_bound", "upper_bound")
        .agg(F.expr("sum(cnt) AS numbers"),
             F.expr("sum(CASE WHEN num < lower_bound OR num > upper_bound THEN cnt ELSE 0L END)"
                    " AS outlier_count"))
        .where("numbers >= 8 AND outlier_count > 0").drop("numbers")
    )
