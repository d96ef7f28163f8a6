"""Duplicates by prints, correlations by co-moments, and what is staged."""

import os

import numpy as np
import pytest

from tableprobe import Dataset, Profile
from tableprobe.dataset import column_refs
from tableprobe.operators import rows, statistics

NESTED = "a int, b int, t string, l array<int>, s struct<x: int, y: int>, m map<string, int>"
ROWS = [
    (None, 1, "x", [1, None], (None, 1), {"a": 1, "b": 2}), (1, None, "x", [1, None], (None, 1), {"a": 1, "b": 2}),
    (1, 1, None, [None, 1], (1, None), None), (1, 1, None, [None, 1], (1, None), None),
    (1, 1, None, [1, None], (1, None), None), (1, 1, None, [None, 1], (None, 1), None), (1, 1, "", [None, 1], (1, None), None),
    (2, 2, "y", [], None, {}), (2, 2, "y", None, None, {}), (2, 2, "y", [], None, {}),
    (3, 3, "m", [], None, {"a": 1, "b": 2}), (3, 3, "m", [], None, {"b": 2, "a": 1}),
]


def counted(datasets):
    prints = rows.repeated_prints(datasets)
    return prints, {r.dataset_no: r.duplicate_rows for r in rows.duplicate_counts(datasets, prints).collect()}


@pytest.mark.parametrize("weak", [False, True])
def test_duplicates(spark, monkeypatch, weak):
    """Nulls in other places tell rows apart; where the first print collides, the second one decides."""
    if weak:
        strong = rows.first_print
        monkeypatch.setattr(rows, "first_print", lambda values: f"pmod({strong(values)}, 3)")
    nested = Dataset("nested", spark.createDataFrame(ROWS, NESTED))
    pairs = Dataset("pairs", spark.range(1000).selectExpr("id % 700 AS k", "CASE WHEN id % 700 < 5 THEN id END AS v"))
    single = Dataset("single", spark.range(10).toDF("id"))
    zeros = Dataset("zeros", spark.sql("SELECT explode(array(0D, -0D, double('nan'), double('nan'), 1D)) AS v"))
    prints, found = counted([nested, pairs, single, zeros])
    assert found == {0: 6, 1: 590, 2: 0, 3: 4}
    assert prints.where("NOT agreed").isEmpty() != weak


def test_no_row_is_moved(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 50 AS k", "repeat('wide', 100) AS wide_text")
        prints = rows.repeated_prints([Dataset("t", df)])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (prints, rows.duplicate_counts([Dataset("t", df)], prints))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanged = [line for p in plans for line in p.splitlines() if "Exchange" in line]
    assert exchanged and not any("wide_text" in line or "k#" in line for line in exchanged)


def test_correlations_by_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)) + 1e9
    x[:, 1] = x[:, 0] * 0.5 + rng.normal(size=3000)
    x[:, 4] = 7.1
    gaps = rng.random((3000, 6)) < 0.2
    gaps[:, 0] = False
    cells = [[None if g else float(v) for v, g in zip(r, h, strict=True)] for r, h in zip(x, gaps, strict=True)]
    cells[5][2] = float("nan")
    schema = ", ".join(f"c{k} double" for k in range(6)) + ", empty double, w int"
    df = spark.createDataFrame([(*r, None, k) for k, r in enumerate(cells)], schema).repartition(7)
    datasets = [Dataset("t", df), Dataset("one", spark.range(3).toDF("id"))]
    refs = column_refs(datasets)
    y = np.array([[np.nan if v is None else v for v in (*r, None, k)] for k, r in enumerate(cells)])
    names = [f"c{k}" for k in range(6)] + ["empty", "w"]
    centres = {r.cid: float(np.nanmean(y[:, k])) + 0.5 for k, r in enumerate(refs[:6])}
    for means in (None, centres):
        found = {(r.x, r.y): r.r for r in statistics.correlations(datasets, refs, means=means).collect()}
        assert len(found) == 64
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
                varied = both.any() and np.ptp(y[both, i]) and np.ptp(y[both, j])
                expected = np.corrcoef(y[both, i], y[both, j])[0, 1] if varied else 0.0
                assert found[a, b] == pytest.approx(expected, abs=1e-4)
    plan = statistics.correlations(datasets, refs, means={})._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan.replace("Generate inline", "")


def staged(profile):
    return sorted(os.listdir(profile.stage.path.removeprefix("file:"))) if os.path.isdir(profile.stage.path) else []


def test_what_is_staged(spark):
    df = spark.range(200).selectExpr("id", "id % 7 AS n", "string(id % 3) AS churn", "repeat(string(id), 9) AS note")
    numbers = Profile([Dataset("t", df)])
    assert numbers.numeric_stats.count() == 2 and numbers.histograms().count() > 0
    assert staged(numbers) == ["number_frequencies", "numbers"]
    rough = Profile([Dataset("t", df)], approximate=True)
    exact = Profile([Dataset("t", df)])
    columns = ("problem_type", "majority_class_pct", "minority_class_pct", "imbalanced")
    assert rough.decision.count() == 1 and not any("frequencies" in name for name in staged(rough))
    assert rough.targets.select(*columns).collect() == exact.targets.select(*columns).collect()
