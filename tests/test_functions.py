"""Value-level expressions, by example."""

import pytest

from tableprobe.functions import masking, text


def evaluate(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").selectExpr(expression("c")).collect()]


def test_strip_and_blank(spark):
    values = ["a", " a ", "\t\u00a0a b\u3000\n", "", " \u2003 ", None, "é", " é", "\x1f-"]
    assert evaluate(spark, text.strip, values) == [v.strip() if v is not None else None for v in values]
    assert evaluate(spark, text.is_blank, values) == [
        None if v is None else not v.strip() for v in values]


def test_normalise(spark):
    assert evaluate(spark, text.normalise, ["  A \t\u00a0 b  ", "a b", "Ção"]) == ["a b", "a b", "ção"]


@pytest.mark.parametrize("value, number", [
    ("1", 1.0), (" -2.5e3 ", -2500.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("1_000", None),
    ("1e400", None), ("NaN", None), ("inf", None), ("", None), ("+", None), ("1,5", None), ("0x1", None),
])
def test_numbers(spark, value, number):
    assert evaluate(spark, text.parse_number, [value]) == [number]


def test_dates(spark):
    good = ["2024-01-10", "2024-1-5", "2024/03/09", "15/03/2024", "03/15/2024", "1/2/2024", "20240110",
            "2024-01-10 23:59:59", "2024-01-10T01:02:03.123456", "2024-01-10T01:02:03Z",
            "2024-01-10 01:02:03-03:00", " 2024-01-10 "]
    bad = ["2024-02-30", "2024", "10:30", "12", "now", "2024-01-10x", "", "31/31/2024", "99999999",
           "2024-01-10 25:00:00", "2024-01", "2024-01-10 01:02:03+19:00"]
    assert all(v is not None for v in evaluate(spark, text.parse_day, good))
    assert evaluate(spark, text.parse_day, bad) == [None] * len(bad)


def test_truth_tokens(spark):
    assert evaluate(spark, text.is_truth_token, [" Yes", "NÃO", "0", "y", "maybe", "10"]) == [
        True, True, True, True, False, False]


def test_personal_content(spark):
    assert evaluate(spark, text.has_personal_content, [
        "mail to a.b+c@x-y.org now", "a@b", "@", "123.456.789-09", "12345678909", "1234567890",
        "123456789012", "id 12345678909.", "joão@exemplo.br", "x12345678909"]) == [
        True, False, False, True, True, False, False, True, True, False]
    df = spark.sql("SELECT stack(7, 12345678909D, 1234567890D, 123.45678909D, 0.12345678909D, 0.5D, "
                   "123456789012D, -12345678909D) AS x")
    assert [r[0] for r in df.selectExpr(text.number_has_personal_content("x")).collect()] == [
        True, False, True, True, False, False, True]


def test_frequency_key(spark):
    long_a, long_b = "x" * 500, "x" * 499 + "y"
    keys = evaluate(spark, text.frequency_key, ["short", long_a, long_b, long_a, "X" * 500])
    assert keys[0] == "short" and keys[1] == keys[3] != keys[2] and len(keys[1]) == 209
    norms = evaluate(spark, lambda c: text.normalised_key(text.frequency_key(c)),
                     [long_a, "X" * 500, "a", "a" + " " * 300, " A "])
    assert norms[0] == norms[1] and norms[2] == norms[3] == norms[4] != norms[0]


def test_masks(spark):
    assert evaluate(spark, masking.mask_value, [None, "", "12345678", "123456789"]) == [
        "***", "***", "***", "12***89"]
    assert evaluate(spark, masking.redact_text, [
        "Authorization: Bearer abc, x", "api-key=zzz", 'API_KEY: "q"', "PassWord = p1; t",
        "token:'abc'", "postgres://u:p@h/db", "plain"]) == [
        "Authorization: Bearer ***, x", "api-key=***", 'API_KEY: "***"', "PassWord = ***; t",
        "token:'***'", "postgres://u:***@h/db", "plain"]
    assert evaluate(spark, masking.redact_url, [
        "http://h/p?a=1&api-key=abcdefghijk&b#f", "http://h/p", "http://h/?token=x&auth", "h?x=#z"]) == [
        "http://h/p?a=1&api-key=ab***jk&b#f", "http://h/p", "http://h/?token=***&auth", "h?x=#z"]
    assert evaluate(spark, masking.redact_connection, [
        "postgresql://me:pw@db:5432/x", "postgresql://db/x", "sqlite:///f", "a://u:p@q@h/x"]) == [
        "postgresql://me:***@db:5432/x", "postgresql://db/x", "sqlite:///f", "a://u:***@h/x"]


def test_mask_columns(spark):
    df = spark.sql("""SELECT 'abcdefghijk' AS api_key, named_struct('Authorization', 'Bearer zyxwv',
        'plain', 'ok', 'deep', array(named_struct('token', 'ttttttttttt', 'n', 1))) AS headers,
        map('my-secret', 'sssssssssss', 'x', 'y') AS m, 5 AS n""")
    r = masking.mask_columns(df).first()
    assert r.api_key == "ab***jk" and r.headers.Authorization == "Be***wv" and r.headers.plain == "ok"
    assert r.headers.deep[0].token == "tt***tt" and r.headers.deep[0].n == 1
    assert r.m == {"my-secret": "ss***ss", "x": "y"} and r.n == 5


def test_maps_of_any_values_are_masked(spark):
    df = spark.sql("""SELECT map('password', array('verysecretvalue'), 'b', array('x')) AS lists,
        map('token', 123456789012, 'n', 5) AS numbers,
        map('inner', named_struct('api_key', 'abcdefghijkl', 'v', 1)) AS structs""")
    row = masking.mask_columns(df).first()
    assert row["lists"] == {"password": None, "b": ["x"]} and row["numbers"] == {"token": None, "n": 5}
    assert row["structs"]["inner"]["v"] == 1 and "cdefgh" not in row["structs"]["inner"]["api_key"]
