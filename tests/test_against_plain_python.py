"""Exact figures against straightforward Python on random tables, with hot values and nulls."""

import math
import random
from collections import Counter

import pytest

from tableprobe import Dataset, Profile

ROWS = 3000


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    rows = []
    for i in range(ROWS):
        hot = i % 3 == 0
        rows.append((
            None if rng.random() < 0.1 else (7 if hot else rng.randrange(-500, 500)),
            rng.choice([None, float("nan"), 1.5, rng.gauss(0, 1), rng.expovariate(0.01)]),
            2**53 + (i % 5),
            None if rng.random() < 0.2 else rng.choice(["", "  ", "A b", "a  B", "x" * 300, "12", "yes"]),
            rng.random() < 0.5,
        ))
    return rows + rows[:40] + [rows[0]] * 5


@pytest.fixture(scope="module", params=["coalesced", "many slices"])
def profile(request, spark, table):
    # Without coalescing the small table is spread over all slices, as a large one would be.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param == "coalesced")
    df = spark.createDataFrame(table, "whole bigint, re double, huge bigint, txt string, b boolean")
    p = Profile([Dataset("t", df.repartition(5))])
    yield p
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def canonical(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def column(table, i):
    return [r[i] for r in table if r[i] is not None]


def test_distinct_and_nulls(profile, table):
    got = {r.ordinal: (r.null_count, r.unique_count) for r in profile.column_profile.collect()}
    for i in range(5):
        values = column(table, i)
        nulls = len(table) - len(values)
        assert got[i] == (nulls, len({canonical(v) for v in values}) + (nulls > 0))


def test_quartiles_and_outliers(profile, table):
    stats = {r.ordinal: r for r in profile.numeric_stats.collect()}
    found = {r.ordinal: r for r in profile.quality.collect()}
    for i in (0, 1, 2):
        values = sorted(map(float, column(table, i)), key=lambda v: (math.isnan(v), v))
        n = len(values)
        q1, q3 = (values[math.floor((n - 1) * q + 0.5)] for q in (0.25, 0.75))
        median = (values[(n - 1) // 2] + values[n // 2]) / 2
        got = stats[i]
        for a, b in ((got.q1, q1), (got.q3, q3), (got.median, median)):
            assert a == b or (a is None and math.isnan(b))
        assert got["count"] == n
        if math.isnan(q1) or math.isnan(q3):
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        outside = sum(v < low or v > high or math.isnan(v) for v in values) if q1 != q3 else 0
        assert (found[i].outlier_count or 0) == outside


def test_slices_hold_all_rows(profile, table):
    totals = profile.stage.small("slices", None) if "slices" in profile.stage else None
    assert totals is not None
    held = Counter()
    for r in totals.collect():
        held[r.cid] += r.held
    assert held == {i: len(column(table, i)) for i in (0, 1, 2)}


def test_duplicates(profile, table):
    counts = Counter(tuple(map(canonical, r)) for r in table)
    assert profile.summary.first().duplicate_rows == sum(n for n in counts.values() if n > 1)


def test_text_counts(profile, table):
    q = {r.column: r for r in profile.quality.collect()}["txt"]
    values = [r[3] for r in table]
    assert q.empty_strings == sum(v is None or v == "" for v in values)
    assert q.whitespace_strings == sum(v == "  " for v in values)
    assert (q.raw_unique, q.normalised_unique) == (7, 5)


def test_top_values(profile, table):
    got = [(r.value, r.cnt) for r in profile.top_values(3).where("column = 'txt'")
           .orderBy("rank").collect()]
    counts = Counter(column(table, 3))
    assert [n for _, n in got] == [n for _, n in counts.most_common(3)]
    assert all(counts[v] == n for v, n in got)


def test_histogram(profile, table):
    bins = profile.histograms().where("column = 're'").orderBy("bin").collect()
    finite = [v for v in column(table, 1) if math.isfinite(v)]
    assert len(bins) == 12 and sum(b.cnt for b in bins) == len(finite)
    step = (max(finite) - min(finite)) / 12
    assert [b.cnt for b in bins] == [
        sum(min(int((v - min(finite)) / step), 11) == i for v in finite) for i in range(12)]


def test_approximate_profile(spark, table):
    df = spark.createDataFrame(table, "whole bigint, re double, huge bigint, txt string, b boolean")
    exact, rough = Profile([Dataset("t", df)]), Profile([Dataset("t", df)], approximate=True)
    want = {r.column: r for r in exact.quality.collect()}
    for r in rough.quality.collect():
        assert abs(r.unique_count - want[r.column].unique_count) <= max(1, 0.05 * want[r.column].unique_count)
        assert r.semantic_type == want[r.column].semantic_type
        assert r.near_constant == want[r.column].near_constant
    a, b = ({r.column: r for r in p.numeric_stats.collect()}["whole"] for p in (exact, rough))
    assert abs(a.q1 - b.q1) <= 5 and abs(a.median - b.median) <= 5
    assert "frequencies" not in rough.stage


def test_approximate_profile_of_unique_values(spark):
    p = Profile([Dataset("t", spark.range(200000).selectExpr("id", "string(id) AS s"))], approximate=True)
    for r in p.quality.collect():
        assert r.possible_id and not r.near_constant


def test_other_types(spark):
    df = spark.sql("""SELECT date'2024-01-01' AS d, X'00FF' AS bin, array(1, 2) AS a, map('k', 1) AS m,
        named_struct('x', 1) AS s, cast(1.25 AS decimal(10, 2)) AS dec, cast(null AS void) AS v,
        interval '1' day AS i, timestamp'2024-01-01 00:00:00' AS ts, cast(1.5 AS float) AS f
        UNION ALL SELECT null, X'00FF', array(), map(), null, 2.5, null, null, null, 1.5""")
    p = Profile([Dataset("t", df)])
    got = {r.column: (r.semantic_type, r.null_count, r.unique_count) for r in p.column_profile.collect()}
    assert got == {
        "d": ("date", 1, 2), "bin": ("categorical", 0, 1), "a": ("categorical", 0, 2),
        "m": ("categorical", 0, 2), "s": ("categorical", 1, 2), "dec": ("numeric", 0, 2),
        "v": ("categorical", 2, 1), "i": ("categorical", 1, 2), "ts": ("date", 1, 2), "f": ("numeric", 0, 1)}
    assert p.decision.count() == 1
    plain = Profile([Dataset("t", df.select("dec"))], decimal_as_categorical=True)
    assert plain.column_profile.first().semantic_type == "categorical"


def test_empty_table(spark):
    p = Profile([Dataset("t", spark.createDataFrame([], "a int, b string"))])
    assert [(r.row_count, r.unique_count, r.null_pct) for r in p.column_profile.collect()] == [(0, 0, 0.0)] * 2
    assert p.problems.count() == 0 and p.summary.first().duplicate_rows == 0
    assert p.decision.first().status == "needs_validation"
