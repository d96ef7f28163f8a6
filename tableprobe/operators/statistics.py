"""Statistics section: numeric and categorical summaries, correlation, histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.dataset import REAL, ColumnRef, Dataset
from tableprobe.functions.sql import finite, literal, records
from tableprobe.operators.frequency import DISPLAY, Texts, ranked_values

BINS = 12


def numeric_stats(facts: DataFrame, quarters: DataFrame) -> DataFrame:
    """Count, moments, range and quartiles per numeric column; an all-null column has no row."""
    joined = facts.where("kind IN ('whole', 'real') AND non_null > 0").join(quarters, "cid", "left")
    return joined.selectExpr(
        "dataset", "ordinal", "column", "non_null AS count",
        *[f"{finite(c)} AS {c}"
          for c in ("mean", "median", "min", "max", "std", "q1", "q3", "skew")],
    )


def described(ranked: DataFrame, facts: DataFrame) -> DataFrame:
    """Ranked values with the names of their columns."""
    names = F.broadcast(facts.select("cid", "dataset", "ordinal", "column"))
    return ranked.join(names, "cid").selectExpr(
        "dataset", "ordinal", "column", "rank", f"{DISPLAY} AS value", "cnt")


def categorical_columns(facts: DataFrame) -> DataFrame:
    return facts.where(
        "semantic_type IN ('categorical', 'boolean', 'text', 'long_text') "
        "AND kind NOT IN ('whole', 'real')"
    )


def categorical_stats(
    facts: DataFrame, frequencies: DataFrame, texts: Texts, top: int | None = 10,
    samples: int | None = 5,
) -> DataFrame:
    """dataset, column, unique figures, and ranked values; part says top or sample."""
    chosen = F.broadcast(categorical_columns(facts).select(
        "cid", "dataset", "ordinal", "column", "unique_count", "unique_rate"))
    own = frequencies.join(chosen, "cid")
    parts = ranked_values(own, texts, top).selectExpr("*", "'top' AS part").union(
        ranked_values(own, texts, samples, by_count=False).selectExpr("*", "'sample' AS part"))
    return parts.selectExpr(
        "dataset", "ordinal", "column", "unique_count", "unique_rate", "part", "rank",
        f"{DISPLAY} AS value", "cnt",
    )


def _co_moments(first_pair: int, width: int, shift: list[float]):
    """A function for mapInArrow: one row for each pair of columns and task.

    Sums go over rows in which both columns are there, of values less `shift` (near the means, so that
    nothing cancels): four products of matrices for a batch, whatever the number of pairs.
    """
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, width, width))
        ends = np.full((2, width, width), np.inf)  # least value and least negated value, by (column, beside)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            mask = there.astype(float)
            with np.errstate(invalid="ignore", over="ignore"):
                sums += np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, (x * x).T @ mask, x.T @ x])
                for side, v in enumerate((x, -x)):
                    if there.all():
                        ends[side] = np.minimum(ends[side], v.min(0, initial=np.inf)[:, None])
                    else:
                        for k in range(width):
                            rows = there[:, k]
                            own = np.where(there[rows], v[rows], np.inf).min(0, initial=np.inf)
                            ends[side, :, k] = np.minimum(ends[side, :, k], own)
        i, j = np.triu_indices(width)
        columns = [sums[0, i, j], sums[1, i, j], sums[2, i, j], sums[3, i, j], sums[3, j, i], sums[4, i, j],
                   ends[0, i, j], -ends[1, i, j], ends[0, j, i], -ends[1, j, i]]
        yield pa.record_batch([pa.array(np.arange(len(i), dtype=np.int32) + first_pair), *map(pa.array, columns)],
                              ["pair", *CO_MOMENTS])
    return added


#: Rows, sums of x, y, x x, y y, x y, and the ends of x and y.
CO_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1")


def correlations(datasets: list[Dataset], refs: list[ColumnRef], limit: int | None = None,
                 means: dict[int, float | None] | None = None) -> DataFrame:
    """dataset, x, y, r: full matrix over the first numeric columns, pairwise complete.

    Each task gives one matrix of co-moments, a row for each pair, and these are summed: a row of the
    table is one row throughout. `means` by cid are what the values are centred by; without them one
    more pass takes them. NaN counts as missing; a constant side gives 0.
    """
    spark = datasets[0].df.sparkSession
    parts, cells = [], []
    for number, dataset in enumerate(datasets):
        columns = [r for r in refs if r.dataset_no == number and r.numeric][:limit]
        if len(columns) < 2:
            continue
        values = dataset.df.selectExpr(*[
            f"nanvl(double({r.sql}), cast(null AS double)) AS v{r.cid}" if r.kind == REAL
            else f"double({r.sql}) AS v{r.cid}"
            for r in columns
        ])
        if means is None:
            centre = list(values.agg(*[F.avg(f"v{r.cid}") for r in columns]).first())
        else:
            centre = [means.get(r.cid) for r in columns]
        centre = [m if m is not None and math.isfinite(m) else 0.0 for m in centre]
        schema = "pair int, " + ", ".join(f"{c} double" for c in CO_MOMENTS)
        parts.append(values.mapInArrow(_co_moments(len(cells), len(columns), centre), schema))
        for i, a in enumerate(columns):
            for b in columns[i:]:
                cells.append({"pair": str(len(cells)), "dataset": literal(dataset.name),
                              "x_ordinal": str(a.ordinal), "x": literal(a.name),
                              "y_ordinal": str(b.ordinal), "y": literal(b.name)})
    if not parts:
        return spark.createDataFrame(
            [], "dataset string, x_ordinal int, x string, y_ordinal int, y string, r double")
    summed = reduce(DataFrame.union, parts).groupBy("pair").agg(
        *[F.sum(c).alias(c) for c in CO_MOMENTS[:6]], *[F.expr(f"{'min' if c.endswith('0') else 'max'}({c}) AS {c}") for c in CO_MOMENTS[6:]])
    measured = summed.selectExpr("pair", """CASE WHEN n = 0 OR x0 = x1 OR y0 = y1 THEN 0D ELSE
        greatest(-1D, least(1D, try_divide(sxy - sx * sy / n, sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))))) END AS r""")
    named = spark.range(1).selectExpr(f"inline({records(cells)})")
    half = named.join(measured, "pair", "left").selectExpr(
        "dataset", "x_ordinal", "x", "y_ordinal", "y", "round(coalesce(r, 0D), 4) AS r")
    mirrored = half.where("x_ordinal != y_ordinal").selectExpr(
        "dataset", "y_ordinal", "y", "x_ordinal", "x", "r")
    return half.union(mirrored)


def histograms(
    metrics: DataFrame, ranged: DataFrame, limit: int | None = None, bins: int = BINS
) -> DataFrame:
    """dataset, column, bin, bin_start, bin_end, cnt over the finite numbers; empty bins kept.

    Bins are counted from the distinct numbers and their frequencies, not from the rows again.
    `limit` keeps the first numeric columns of each dataset.
    """
    numeric = metrics.where("kind IN ('whole', 'real')").selectExpr(
        "cid", "dataset", "ordinal", "column", "finite_min AS low", "finite_max AS high",
        f"(finite_max - finite_min) / {bins} AS step",
        "row_number() OVER (PARTITION BY dataset_no ORDER BY ordinal) AS place",
    ).where("low IS NOT NULL" + ("" if limit is None else f" AND place <= {limit}"))
    frame = numeric.selectExpr(
        "*", f"explode(sequence(0, CASE WHEN low = high THEN 0 ELSE {bins - 1} END)) AS bin"
    ).selectExpr(
        "cid", "dataset", "ordinal", "column", "bin", "low + bin * step AS bin_start",
        "CASE WHEN low = high THEN high ELSE low + (bin + 1) * step END AS bin_end",
    )
    counted = (
        ranged.where("abs(num) < double('infinity')")
        .join(F.broadcast(numeric.select("cid", "low", "high", "step")), "cid")
        .groupBy("cid", F.expr(
            "CASE WHEN low = high THEN 0 "
            f"ELSE int(least(floor(try_divide(num - low, step)), {bins - 1})) END AS bin"))
        .agg(F.expr("sum(cnt) AS cnt"))
    )
    return frame.join(counted, ["cid", "bin"], "left").selectExpr(
        "dataset", "ordinal", "column", "bin", "bin_start", "bin_end", "coalesce(cnt, 0L) AS cnt")
