"""Readers, paging, the read-only check and the report store."""

import json
import re

import pytest

from tableprobe import Dataset, Profile
from tableprobe.sources import files, paged, records, sql
from tableprobe.sources.store import ReportStore


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_separator_is_detected(spark, tmp_path):
    d = files.load_file(spark, write(tmp_path, "a.csv", "id;status\n1;ok\n2;fail\n"))
    assert d.name == "a" and d.metadata["separator"] == ";"
    assert d.df.dtypes == [("id", "int"), ("status", "string")] and d.df.count() == 2


def test_late_bad_value_makes_the_file_text(spark, tmp_path):
    body = "id,value,note\n" + "".join(f"{i},{i},\n" for i in range(1001)) + "1002,oops,x\n"
    path = write(tmp_path, "late.csv", body)
    df, meta = files.read_csv(spark, path)
    assert meta["csv_fallback"] and {t for _, t in df.dtypes} == {"string"}
    assert df.where("id = '1002'").first().value == "oops" and df.count() == 1002
    assert df.where("note = ''").count() == 1001
    by_column, _ = files.read_csv(spark, path, fallback="column")
    assert dict(by_column.dtypes)["id"] == "int" and dict(by_column.dtypes)["value"] == "string"


def test_latin_text(spark, tmp_path):
    path = write(tmp_path, "l.csv", "id,city\n1,São Paulo\n", encoding="latin-1")
    df, meta = files.read_csv(spark, path)
    assert meta["encoding"] == "ISO-8859-1" and df.first().city == "São Paulo"


def test_dates_are_typed(spark, tmp_path):
    df, _ = files.read_csv(spark, write(tmp_path, "d.csv", "day,x\n2024-01-10,1.5\n2024-02-11,2\n"))
    assert df.dtypes == [("day", "date"), ("x", "double")]


@pytest.mark.parametrize("document, path, columns, expected", [
    ({"response": {"items": [{"id": 1, "user": {"name": "Ana"}}]}}, None, ["id", "user.name"], [(1, "Ana")]),
    ({"data": [None, {"id": 1, "name": "Ana"}]}, None, ["id", "name"], [(1, "Ana")]),
    ({"x": {"y": [1, 2]}}, "x.y", ["value"], [(1,), (2,)]),
    ({"x": {"id": 5}}, "x", ["id"], [(5,)]),
    ({"x": 7}, "x", ["value"], [(7,)]),
    ({"id": 9}, "no.such", ["id"], [(9,)]),
    ({"data": 3, "items": [{"id": 4}]}, None, ["id"], [(4,)]),
    ({"data": [], "items": [{"id": 4}]}, None, [], []),
    ({"response": {"data": "z"}}, None, ["value"], [("z",)]),
])
def test_json_records(spark, tmp_path, document, path, columns, expected):
    df = files.read_json(spark, write(tmp_path, "j.json", json.dumps(document)), path)
    assert df.columns == columns
    assert [tuple(r) for r in df.collect()] == expected


def test_dotted_columns_profile(spark, tmp_path):
    body = json.dumps({"items": [{"id": i, "user": {"name": f"n{i}"}, "tags": ["a"]} for i in range(4)]})
    d = files.load_file(spark, write(tmp_path, "p.json", body))
    p = Profile([d])
    got = {r.column: r.semantic_type for r in p.column_profile.collect()}
    assert got == {"id": "numeric", "tags": "categorical", "user.name": "text"}
    assert p.summary.first().duplicate_rows == 0


def test_path_lookup(spark):
    df = spark.createDataFrame([((1, "a"),)], "u struct<id: int, name: string>")
    assert df.selectExpr(records.at_path(df.schema, "u.name")).first()[0] == "a"
    assert df.selectExpr(records.at_path(df.schema, "u.name.first")).first()[0] is None


def test_parquet_and_names(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert files.load_file(spark, str(tmp_path / "t.parquet")).df.count() == 3
    with pytest.raises(ValueError):
        files.load_file(spark, "a.xlsx")
    assert files.dataset_name({"type": "sql", "table": "s.t"}, 0) == "s.t"
    assert files.dataset_name({"type": "file", "name": "x.csv"}, 0) == "x"
    assert files.dataset_name({}, 2) == "dataset_3"
    record = files.source_record(files.load_file(spark, str(tmp_path / "t.parquet"))).first()
    assert record.source_extension == ".parquet" and record.parquet is True


def test_sql(spark):
    spark.range(20).createOrReplaceTempView("twenty")
    assert sql.load_sql(spark, table="twenty", limit=7).df.count() == 7
    assert sql.load_sql(spark, query="select id from twenty where id > 4;").df.count() == 15
    for bad in ("DROP TABLE customers", "select 1; delete from t", "with x as (select 'drop') select 1"):
        with pytest.raises(ValueError):
            sql.load_sql(spark, query=bad)
    for wrong in ({"table": "a b"}, {}, {"table": "t", "query": "select 1"}, {"table": "t", "limit": 0}):
        with pytest.raises(ValueError):
            sql.load_sql(spark, **wrong)
    queries = spark.createDataFrame(
        [("SELECT 1",), (" with a as (select 1) select * from a",), ("select dropped from t",),
         ("update t set a = 1",), ("select 'drop'",)], "q string")
    assert [r[0] for r in queries.selectExpr(sql.is_read_only("q")).collect()] == [
        True, True, True, False, False]


def test_sql_reads_all_rows_unless_a_limit_is_given(spark):
    spark.range(1_200_000).createOrReplaceTempView("many_rows")
    whole = sql.load_sql(spark, table="many_rows")
    assert whole.df.count() == 1_200_000 and whole.metadata["truncated"] is False and whole.source["limit"] is None
    cut = sql.load_sql(spark, query="select id, rand() as r from many_rows", limit=1_100_000)
    assert cut.df.count() == 1_100_000 and cut.metadata["truncated"] is True
    few = sql.load_sql(spark, query="select id, rand() as r from many_rows where id < 50", limit=20)
    assert few.metadata["truncated"] is True and sorted(few.df.collect()) == sorted(few.df.collect())
    exact = sql.load_sql(spark, query="select id from many_rows where id < 20", limit=20)
    assert exact.df.count() == 20 and exact.metadata["truncated"] is False


def numbered_pages(total):
    def fetch(url, params):
        limit = params["limit"]
        start = params["offset"] if "offset" in params else (params["page"] - 1) * limit
        return {"items": [{"id": i, "who": {"n": f"x{i}"}} for i in range(start, min(start + limit, total))]}
    return fetch


@pytest.mark.parametrize("mode, total, pages, expected", [
    ("page_limit", 7, 5, 7), ("offset_limit", 7, 5, 7), ("page_limit", 100, 3, 9),
    ("page_limit", 6, 5, 6), ("offset_limit", 0, 2, 0),
])
def test_numbered_pages(spark, mode, total, pages, expected):
    paging = paged.Paging(mode=mode, limit=3, max_pages=pages)
    d = paged.load_pages(spark, "http://x/items", numbered_pages(total), paging)
    assert d.df.count() == expected
    if expected:
        assert d.df.columns == ["id", "who.n"]
        assert sorted(r.id for r in d.df.collect()) == list(range(expected))


def test_short_page_ends_the_source(spark):
    def fetch(url, params):
        sizes = {1: 3, 2: 1, 3: 3}
        return [{"page": params["page"]}] * sizes[params["page"]]
    got = paged.read_pages(spark, "u", fetch, paged.Paging(mode="page_limit", limit=3))
    assert sorted(r.page for r in got.collect()) == [0, 0, 0, 1]


@pytest.mark.parametrize(("mode", "total"), [("page_limit", 200), ("offset_limit", 200), ("page_limit", 180), ("offset_limit", 0)])
def test_all_numbered_pages_by_default(spark, mode, total):
    d = paged.load_pages(spark, "u", numbered_pages(total), paged.Paging(mode=mode, limit=3))
    assert d.df.count() == total and d.metadata["truncated"] is False
    if total:
        assert sorted(r.id for r in d.df.collect()) == list(range(total))


def test_cut_pages_are_marked(spark):
    load = lambda total: paged.load_pages(
        spark, "u", numbered_pages(total), paged.Paging(mode="page_limit", limit=3, max_pages=2)).metadata["truncated"]
    assert load(100) is True and load(5) is False

    def tokens(url, params):
        n = params.get("next_token", 0)
        return {"data": [{"n": n}], "next_token": n + 1 if n < 69 else None}
    whole = paged.load_pages(spark, "u", tokens, paged.Paging(mode="next_token"))
    assert whole.df.count() == 70 and whole.metadata["truncated"] is False
    cut = paged.load_pages(spark, "u", tokens, paged.Paging(mode="next_token", max_pages=4))
    assert cut.df.count() == 4 and cut.metadata["truncated"] is True


def test_a_chain_that_comes_back_is_an_error(spark):
    with pytest.raises(Exception, match="comes back"):
        paged.load_pages(spark, "http://h/a", lambda url, params: {"data": [{"n": 1}], "next": "/a"}, paged.Paging(mode="next_url"))


def test_chained_pages(spark):
    def links(url, params):
        n = int(re.search(r"(\d+)$", url).group(1))
        return {"data": [{"n": n}], "next": f"page{n + 1}" if n < 3 else None}
    chain = paged.Paging(mode="next_url", max_pages=10)
    assert sorted(r.n for r in paged.load_pages(spark, "http://h/a/page1", links, chain).df.collect()) == [1, 2, 3]

    def tokens(url, params):
        n = params.get("next_token", 0)
        return {"data": [{"n": n}], "meta": {"more": n + 1}}
    chain = paged.Paging(mode="next_token", max_pages=4, next_path="meta.more")
    assert sorted(r.n for r in paged.load_pages(spark, "u", tokens, chain).df.collect()) == [0, 1, 2, 3]


def test_single_page_and_preview(spark):
    def fetch(url, params):
        return {"results": [{"id": i} for i in range(params.get("limit", 40))]}
    assert paged.load_pages(spark, "u", fetch).df.count() == 40
    assert paged.preview(spark, "u", fetch, paged.Paging(mode="page_limit")).count() == 5
    with pytest.raises(ValueError):
        paged.Paging(mode="page_limit", max_pages=51)


def test_store(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "reports"))
    assert store.history() is None
    df = spark.createDataFrame([(1, "yes"), (2, "no")], "id bigint, target string")
    profile = Profile([Dataset("t", df)])
    first, second = store.save(profile), store.save(profile)
    assert re.match(r"^[a-f0-9]{12}$", first)
    assert [r.id for r in store.history().collect()] == [second, first]
    assert store.read(first, "summary").first().row_count == 2
    assert store.read(first, "problems").count() == profile.problems.count()
    assert store.read("..", "summary") is None and store.read("0" * 12, "summary") is None
    assert store.read(first, "nothing") is None and store.report("0" * 12) is None
    assert set(store.report(first)) >= {"summary", "problems", "recommendation"}


@pytest.mark.parametrize(("body", "columns", "expected"), [
    ('id,t\n1,"line one\nline two"\n2,b\n', ["id", "t"], [(1, "line one\nline two"), (2, "b")]),
    ('id,t\n1,"he said ""hi"", ok"\n', ["id", "t"], [(1, 'he said "hi", ok')]),
    ('id;t\n1;"a,b,c,d"\n', ["id", "t"], [(1, "a,b,c,d")]),
    ("a,a,b\nx,y,z\n", ["a", "a_2", "b"], [("x", "y", "z")]),
    ("id,v,w\n1,x\n2,y,z\n", ["id", "v", "w"], [(1, "x", None), (2, "y", "z")]),
])
def test_csv_cells(spark, tmp_path, body, columns, expected):
    df, _ = files.read_csv(spark, write(tmp_path, "q.csv", body))
    assert df.columns == columns
    assert sorted(map(tuple, df.collect())) == expected


def test_csv_rows_beyond_the_header(spark, tmp_path):
    with pytest.raises(ValueError, match="1 rows"):
        files.read_csv(spark, write(tmp_path, "x.csv", "id,v\n1,a\n3,4,5\n"))


def test_csv_latin_header(spark, tmp_path):
    df, meta = files.read_csv(spark, write(tmp_path, "h.csv", "código,x\n1,á\n", encoding="latin-1"))
    assert df.columns == ["código", "x"] and df.first()["x"] == "á" and meta["encoding"] == "ISO-8859-1"


def test_json_lines(spark, tmp_path):
    df = files.read_json(spark, write(tmp_path, "l.json", '{"a":1}\n{"a":2}\n{"a":3}\n'))
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="two.json"):
        files.read_json(spark, write(tmp_path, "two.json", '{\n"a":1}\n{\n"a":2}\n'))


def test_paged_address_is_masked(spark):
    d = paged.load_pages(spark, "https://u:pw12345678@host/x?api_key=abcdefghijkl&n=1", lambda url, params: {"data": [{"a": 1}, {"a": 2}]})
    assert d.metadata["records_loaded"] == 2
    for shown in (d.name, d.source["url"]):
        assert "abcdefghijkl" not in shown and "pw12345678" not in shown and "host" in shown
