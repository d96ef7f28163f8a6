"""What is looked at once for each distinct value, and once for each document."""

from tableprobe import Dataset, Profile
from tableprobe.operators import metrics
from tableprobe.sources import documents


def dataset(spark):
    odd = ["", "  ", None, "2024-01-15", "20240115", "15/03/2024", "yes", "0", "-1.5e3", "a@b.co", "123.456.789-01",
           "x" * 200, "é" * 200, "é" * 201, " " * 300, "0" * 260 + "7", "w " * 150 + "a@b.co", "bad �", "straße"]
    rows = [(k, v, 20240115.0, [v]) for k, v in enumerate(odd * 40)]
    return Dataset("t", spark.createDataFrame(rows, "id bigint, v string, sale_date double, list array<string>"))


def test_text_metrics_read_each_distinct_value_once(spark):
    p = Profile([dataset(spark)])
    refs = [r for r in p.refs if not r.numeric]
    counted = metrics.counted_texts(p.datasets, refs, p.other_freq)
    # Texts that the frequencies hold as they are take one row each; longer ones are read again.
    short = counted.where("char_length(v) <= 200")
    assert short.count() == short.select("cid", "v").distinct().count() < 40
    assert counted.agg({"n": "sum"}).first()[0] == 18 * 40 + 19 * 40


def test_text_metrics_are_those_of_all_rows(spark):
    for dominant in (False, True):
        p = Profile([dataset(spark)], dominant_format=dominant)
        every = metrics.column_metrics(p.datasets, p.refs, dominant)
        assert sorted(map(str, p.metrics.collect())) == sorted(map(str, every.collect()))


def test_short_texts_are_not_searched_for_numbers_of_eleven_digits(spark):
    from tableprobe.functions import text
    found = spark.createDataFrame([("12345678901",), ("123.456.789-01",), ("1234567890",), ("a@b.c",), ("",)], "v string")
    assert [r[0] for r in found.selectExpr(text.has_personal_content("v")).collect()] == [True, True, False, True, False]


def test_a_json_text_is_parsed_once(spark):
    texts = {'{"a":"}{"}': True, '[1, "]"] ': True, '{"a":1} {"b":2}': False, '{"a":1} x': False, "1": True, '"a b"': True,
             "1 2": False, '{"a":1}"}': False, '{"a":1': False, '["\\"]"]': True, "[]": True, "{} ]": False, "": False}
    seen = documents.parsed(spark.createDataFrame([(t,) for t in texts], "value string"))
    test = documents.is_one_value("value", "doc")
    assert "parse_json" not in test
    assert {r["value"]: r["one"] for r in seen.selectExpr("value", f"{test} AS one").collect()} == texts


def test_a_list_of_records_is_opened_once(spark):
    lists = {'[{"a":1}]': True, '[null,{"a":1}]': True, "[]": True, "[null]": True, '[1,{"a":1}]': False, "{}": False, "1": False}
    test = documents.lists_objects("v")
    assert test.count("array<variant>") == 1
    found = spark.createDataFrame([(t,) for t in lists], "t string").selectExpr("t", "parse_json(t) AS v").selectExpr("t", f"{test} AS l")
    assert {r["t"]: r["l"] for r in found.collect()} == lists
