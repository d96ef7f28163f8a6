"""Widths of the advice and the data dictionary."""

from pyspark.sql import functions as F

from tableprobe import Dataset, Profile


def test_widths_are_arguments(spark):
    df = spark.range(40).selectExpr(
        "id", "CASE WHEN id % 3 > 0 THEN concat('a', id % 11) END AS city", "concat('u', id, '@x.org') AS email",
        "id % 2 AS target")
    narrow = Profile([Dataset("t", df)], merged_rules=1, notes=1, examples=2)
    wide = Profile([Dataset("t", df)], merged_rules=None, notes=None, examples=None)
    usual = Profile([Dataset("t", df)])
    matched = wide.rule_matches.count()
    assert matched > 1
    items = [p.recommendation.count() for p in (narrow, usual, wide)]
    assert items[0] < items[1] <= items[2]
    # Warnings about sensitive fields stand behind the advice of all rules.
    sizes = [{r["column"]: (len(r.examples), len(r.notes)) for r in p.data_dictionary.collect()}
             for p in (narrow, usual, wide)]
    assert [s["city"][0] for s in sizes] == [2, 5, 11]
    assert all(s[1] <= 1 for s in sizes[0].values()) and all(s[1] <= 2 for s in sizes[1].values())
    full = {r["column"]: r.n for r in wide.column_actions.select("column", F.size("reason_codes").alias("n")).collect()}
    assert {c: s[1] for c, s in sizes[2].items()} == full
