"""Cells with line breaks read by many tasks, checks of a file, and JSON of any shape, from any folder."""

import csv
import io
import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from tableprobe.sources import files, quoted


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_cells(seed, rows, longest):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice('ab ,;"\n\r\né') for _ in range(r.randint(0, longest)))
    return [(k, cell() or None, cell() or None) for k in range(rows)]


def csv_text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([("id", "a", "b"), *[["" if v is None else v for v in row] for row in rows]])
    return out.getvalue()


@pytest.mark.parametrize(("seed", "rows", "longest", "end"), [(1, 300, 40, "\n"), (2, 14, 9000, "\n"), (3, 200, 3, "\r\n")])
def test_cells_with_breaks_over_many_tasks(spark, tmp_path, small_splits, seed, rows, longest, end):
    expected = random_cells(seed, rows, longest)
    for k in range(2):  # two files, each with its header
        (tmp_path / f"part{k}.csv").write_bytes(csv_text(expected[k::2], end).encode())
    df, meta = files.read_csv(spark, str(tmp_path), ",")
    assert meta["multi_line"] and df.dtypes[0] == ("id", "int")
    found = sorted(map(tuple, df.collect()))
    assert len(found) == len(expected)
    assert found == expected
    ranges = quoted.survey(spark, str(tmp_path), ",")
    if longest > 3:
        assert len(ranges.inside) > 2 and any(ranges.inside.values())


def test_as_the_reader_of_one_task(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text(csv_text(random_cells(5, 200, 30)).replace("\r", " "))
    df, _ = files.read_csv(spark, str(path), ",")
    one = spark.read.options(header=True, multiLine=True, escape='"', sep=",").schema(df.schema).csv(str(path))
    assert sorted(map(repr, df.collect())) == sorted(map(repr, one.collect()))
    assert one.rdd.getNumPartitions() == 1 < df.rdd.getNumPartitions()


def test_states_compose():
    rng = np.random.default_rng(0)
    for _ in range(300):
        out, in_ = rng.random(12) < 0.5, rng.random(12) < 0.5
        for start in (0, 1):
            state, expected = start, []
            for o, i in zip(out, in_, strict=True):
                state = int(i if state else o)
                expected.append(state)
            assert quoted.states_after(out, in_, start).tolist() == expected


@pytest.mark.parametrize(("line", "outside", "inside"), [
    ("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a","b', True, True), ('5" pipe,3', False, False),
    ('"a""', True, False), ('"a""b"', False, False), ('x"y,"z', True, True), ("", False, True), ('"', True, False), ('"a"b,"c', True, True),
])
def test_line_ends(spark, line, outside, inside):
    pattern = quoted.open_end(",")
    found = spark.createDataFrame([(line, pattern)], "v string, p string").selectExpr("v RLIKE p", "concat('\"', v) RLIKE p").first()
    assert tuple(found) == (outside, inside)


@pytest.mark.parametrize("row", ["3,4,,5", "3,4,", '3,"4,4",x', "3,4,5"])
@pytest.mark.parametrize("more", ["", '9,"two\nlines"\n'])
def test_long_rows_are_an_error(spark, tmp_path, row, more):
    path = tmp_path / "x.csv"
    path.write_text(f'id,v\n1,a\n{more}{row}\n2,"b,c"\n')
    with pytest.raises(ValueError, match="1 rows"):
        files.read_csv(spark, str(path), ",")


def test_late_break_in_spanning_file(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text('id,n,t\n1,1,"a\nb"\n' + "".join(f"{k},{k},x\n" for k in range(2, 1500)) + "1500,oops,\n")
    df, meta = files.read_csv(spark, str(path))
    assert meta["csv_fallback"] and df.where("n = 'oops' AND t = ''").count() == 1 and df.where("t = 'a\nb'").count() == 1
    by_column, _ = files.read_csv(spark, str(path), fallback="column")
    assert dict(by_column.dtypes) == {"id": "int", "n": "string", "t": "string"} and by_column.count() == 1500


@pytest.mark.parametrize(("body", "encoding", "columns", "expected"), [
    ('id,"two\nnames"\n1,"a\nb"\n', "utf-8", ["id", "two\nnames"], [(1, "a\nb")]),
    ('cidade,x\n"São\nPaulo",1\n', "latin-1", ["cidade", "x"], [("São\nPaulo", 1)]),
    ('﻿id,x\n1,"a\nb"\n', "utf-8", ["id", "x"], [(1, "a\nb")]),
    ('id\n"1\n2"\n"3"\n', "utf-8", ["id"], [("1\n2",), ("3",)]),
    ('\n\nid,x\n\n1,"a\n\nb"\n  \n2,c\n', "utf-8", ["id", "x"], [(1, "a\n\nb"), (2, "c")]),
    ("id,x\r1,a\r2,b\r", "utf-8", ["id", "x"], [(1, "a"), (2, "b")]),
    ('id,x\n1,a\n2,"never closed\n', "utf-8", ["id", "x"], None),
])
def test_odd_files(spark, tmp_path, body, encoding, columns, expected):
    path = tmp_path / "o.csv"
    path.write_bytes(body.encode(encoding))
    df, _ = files.read_csv(spark, str(path), ",")
    assert df.columns == columns
    found = sorted(map(tuple, df.collect()))
    assert found == expected if expected is not None else len(found) == 2


def test_two_passes(spark, tmp_path, small_splits):
    """An ordinary file is read twice in full before it is returned: its lines, then its rows."""
    path = tmp_path / "p.csv"
    path.write_text("id,v\n" + "".join(f"{k},x{k}\n" for k in range(2500)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("passes", "passes")
    df, _ = files.read_csv(spark, str(path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    splits = df.rdd.getNumPartitions()
    stages = [s for j in tracker.getJobIdsForGroup("passes") for s in tracker.getJobInfo(j).stageIds]
    assert splits > 10 and sum(tracker.getStageInfo(s).numCompletedTasks == splits for s in stages) == 2


JSON_FOLDERS = [
    ({"a.json": '{"data":[{"a":1}]}', "b.json": '{"items":[{"a":2},{"a":3}]}'}, [(1,), (2,), (3,)]),
    ({"a.json": '{"a":1} {"a":2}'}, [(1,), (2,)]),
    ({"a.json": '{"a":1}{"a":2}\n{"a":3}\n\n'}, [(1,), (2,), (3,)]),
    ({"a.json": '{\n  "a": 1\n}'}, [(1,)]),
    ({"with space.json": '{\n  "data": [\n {"a": 1},\n null, {"a": 2}]\n}', "b.json": '{"a":3}\n{"a":4}\n'}, [(1,), (2,), (3,), (4,)]),
    ({"a.json": '[{"a":1},{"a":2}]'}, [(1,), (2,)]),
    ({"a.json": '{"data":{"x":1},"response":{"data":{"a":7}}}'}, [(7,)]),
    ({"a.json": '{"items":[],"a":1}\n{"a":2}'}, [(2,)]),
    ({"a.json": '{"a":"} {"}\n{"a":"\\"],["}'}, [("\"],[",), ("} {",)]),
]


@pytest.mark.parametrize(("folder", "expected"), JSON_FOLDERS)
def test_json_of_any_shape(spark, tmp_path, folder, expected):
    for name, body in folder.items():
        (tmp_path / name).write_text(body)
    df = files.read_json(spark, str(tmp_path))
    assert df.columns == ["a"] and sorted(map(tuple, df.collect())) == expected


@pytest.mark.parametrize("body", ['{"a":1},{"a":2}', '{"a":1', '{\n"a":1}\n{\n"a":2}\n', '{"a":1} x', "[1,2],", '{"a":1}]'])
def test_json_that_is_none(spark, tmp_path, body):
    (tmp_path / "bad.json").write_text(body)
    (tmp_path / "good.json").write_text('{"a":1}')
    with pytest.raises(ValueError, match="bad.json"):
        files.read_json(spark, str(tmp_path))


def by_the_rule(document, data_path=None):
    """The records of one document, in plain Python."""
    paths = ("data", "items", "results", "response.items", "response.data")

    def look(path):
        value = document
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value

    def records(value):
        filled = [v for v in value if v is not None] if isinstance(value, list) else None
        return filled is not None and (not filled or isinstance(filled[0], dict))

    found = look(data_path) if data_path else None
    if found is None and isinstance(document, dict):
        found = next((look(p) for p in paths if records(look(p))), look(paths[-1]))
    found = document if found is None else found
    if isinstance(found, dict):
        return [found]
    if isinstance(found, list):
        return [v for v in found if isinstance(v, dict)] if records(found) else [{"value": v} for v in found]
    return [{"value": found}]


@pytest.mark.parametrize("data_path", [None, "x", "response.items", "x.y"])
def test_records_by_the_rule(spark, tmp_path, data_path):
    r = random.Random(4)

    def value(depth):
        kind = r.randint(0, 6 if depth else 3)
        if kind == 0:
            return None
        if kind < 4:
            return r.choice([1, 2.5, "t", 'q"}{', True, -3])
        if kind == 4:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return {k: value(depth - 1) for k in r.sample(["data", "items", "results", "response", "x", "y"], r.randint(0, 4))}
    documents = [value(4) for _ in range(300)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, documents)))
    from tableprobe.sources import documents as module

    texts, _ = module.documents(spark, str(tmp_path))
    found = texts.selectExpr("parse_json(value) AS d").selectExpr(f"{module.chosen('d', data_path)} AS c").selectExpr(
        f"explode({module.record_texts('c')}) AS value")
    expected = [record for d in documents for record in by_the_rule(d, data_path)]
    form = lambda v: json.dumps(v, sort_keys=True)
    assert sorted(form(json.loads(r.value)) for r in found.collect()) == sorted(map(form, expected))


def test_away_from_the_repository(tmp_path):
    """Workers of a session that was started elsewhere know the package by value."""
    (tmp_path / "j.json").write_text('{\n"a": 1\n}')
    (tmp_path / "k.json").write_text('{"a":1} {"a":2}')
    (tmp_path / "c.csv").write_text('id,v\n1,"a\nb"\n')
    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
from tableprobe.sources import files
print(files.read_json(spark, {str(tmp_path / 'j.json')!r}).count(), files.read_json(spark, {str(tmp_path / 'k.json')!r}).count(),
      files.read_csv(spark, {str(tmp_path / 'c.csv')!r})[0].count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.split() == ["1", "2", "1"], done.stderr[-2000:]
