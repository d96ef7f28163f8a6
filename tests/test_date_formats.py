"""One date format a column: the most frequent counts, days in others are words."""

import pytest

from tableprobe import Dataset, Profile


def profile(spark, columns, **options):
    rows = [tuple(v) for v in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return Profile([Dataset("t", df)], dominant_format=True, **options), df


COLUMNS = {
    # 3/4/2024 is a day in both slashed formats, 25/4 and 26/4 in one of them only.
    "slashed": ["3/4/2024", "25/4/2024", "26/4/2024", "4/30/2024", None, " 27/4/2024\t"],
    "tied": ["2024-01-05", "20240105", "2024/01/05", "", " ", None],
    "compact": ["20240105", "20240230", "20240106", "2024-01-07", "12345678", "x"],
    "moments": ["2024-01-05T10:00:00Z", "2024-01-06 10:00:00", "2024-01-07", "2024-13-01T10:00:00", "y", None],
    "words": ["a", "b", "", None, "yes", "1"],
}


@pytest.mark.parametrize("approximate", [False, True])
def test_formats(spark, approximate):
    p, _ = profile(spark, COLUMNS, approximate=approximate)
    assert {r["column"]: (r.date_format, r.dates, r.other_dates) for r in p.date_formats.collect()} == {
        "slashed": ("day/month/year", 4, 1), "tied": ("year-month-day", 1, 2),
        "compact": ("compact", 2, 1), "moments": ("moment", 2, 1)}


def test_codes_follow_the_format(spark):
    p, df = profile(spark, COLUMNS)
    plain = Profile([Dataset("t", df)]).metrics
    codes = [f"code{k}" for k in range(1, 10)]
    before = {r["column"]: [r[c] for c in codes] for r in plain.collect()}
    after = {r["column"]: [r[c] for c in codes] for r in p.metrics.collect()}
    assert {c: sum(v) for c, v in before.items()} == {c: sum(v) for c, v in after.items()}  # no value is lost
    assert before["words"] == after["words"]
    # Empty, blank, truth number, number, day number, truth word, truth letter, day, words.
    assert after["slashed"] == [0, 0, 0, 0, 0, 0, 0, 4, 1]
    assert after["tied"] == [1, 1, 0, 1, 0, 0, 0, 1, 1]
    assert after["compact"] == [0, 0, 0, 2, 2, 0, 0, 0, 2]


def test_type_follows_the_format(spark):
    days = [f"2024-01-{k:02}" for k in range(1, 8)] + ["15/01/2024", "16/01/2024", "17/01/2024"]
    p, df = profile(spark, {"day": days})
    kind = lambda q: q.column_profile.first().semantic_type
    assert kind(Profile([Dataset("t", df)])) == "date" != kind(p)


def test_no_texts(spark):
    df = spark.range(3).selectExpr("id", "id * 2.5D AS price")
    assert Profile([Dataset("t", df)], dominant_format=True).date_formats.count() == 0
    empty, _ = profile(spark, {"day": [None]})
    assert empty.date_formats.count() == 0
    with pytest.raises(ValueError):
        Profile([Dataset("t", df)]).date_formats
