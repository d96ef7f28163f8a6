"""Atomic reports, sizes of files, JSON-safe rows, and how many pages are looked at."""

import json
import math

import pytest

from tableprobe import Dataset, Profile
from tableprobe.functions.safe import json_rows
from tableprobe.sources import paged
from tableprobe.sources.store import MULTI_SECTIONS, SECTIONS, ReportStore


def test_all_sections_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, "yes", 1.5), (2, "no", float("nan"))], "id bigint, target string, v double")
    store = ReportStore(spark, str(tmp_path / "r"))
    report = store.save(Profile([Dataset("a", df), Dataset("b", df.limit(1))]))
    assert set(store.report(report)) == set(SECTIONS) | set(MULTI_SECTIONS)
    shown = [json.loads(r.record) for r in store.read(report, "preview").orderBy("dataset", "rank").collect()]
    assert shown[0] == {"id": 1, "target": "yes", "v": 1.5} and shown[1] == {"id": 2, "target": "no", "v": None}


def test_a_broken_run_leaves_nothing_visible(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "r"))
    whole = store.save(Profile([Dataset("a", spark.range(3).toDF("id"))]))

    class Broken(Profile):
        @property
        def decision(self):
            raise RuntimeError("lost")
    ids = []
    path = store._path
    store._path = lambda section, report: ids.append(report) or path(section, report)
    with pytest.raises(RuntimeError, match="lost"):
        store.save(Broken([Dataset("a", spark.range(3).toDF("id"))]))
    assert len(set(ids)) == 1 and ids[0] != whole
    assert [r.id for r in store.history().collect()] == [whole]
    assert store.report(ids[0]) is None and store.read(ids[0], "summary") is None


def test_file_sizes(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(500).repartition(3).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    p = Profile([Dataset("files", spark.read.parquet(path)), Dataset("made", spark.range(5).toDF("id"))])
    assert [(r.bytes, r.megabytes) for r in p.summary.orderBy("dataset_no").collect()] == [(size, round(size / 2**20, 2)), (None, None)]
    assert p.combined_summary.first().bytes == size


def test_json_safe_rows(spark):
    df = spark.sql("""SELECT double('NaN') AS a, float('inf') AS b, array(1D, double('-inf'), null) AS c,
        named_struct('x', map('k', double('nan')), 'y', array(named_struct('z', 2.5D, 't', 'q"'))) AS d,
        cast(null AS struct<v: double>) AS e, 'NaN' AS f""")
    got = json.loads(json_rows(df).first().record, parse_constant=pytest.fail)
    assert got == {"a": None, "b": None, "c": [1.0, None, None], "d": {"x": {"k": None}, "y": [{"z": 2.5, "t": 'q"'}]}, "e": None, "f": "NaN"}


@pytest.mark.parametrize("pages", [0, 1, 2, 3, 7, 8, 9, 100, 1000])
def test_last_page(pages):
    looked = []
    assert paged.last_page(lambda i: looked.append(i) or i < pages) == pages
    assert len(looked) <= 2 * math.log2(pages + 2) + 2
    assert sum(i > pages for i in looked) <= math.log2(pages + 2) + 1


def test_runs_of_pages(spark):
    def fetch(url, params):
        start = (params["page"] - 1) * params["limit"]
        return {"items": [{"id": i} for i in range(start, min(start + params["limit"], 1234))]}
    paging = paged.Paging(mode="page_limit", limit=2)
    runs = paged.PagedReader("u", paging, None, fetch).partitions()
    assert len(runs) == -(-618 // 3) and (runs[0].start, runs[-1].stop) == (0, 618)
    d = paged.load_pages(spark, "u", fetch, paging)
    assert d.df.count() == 1234 and d.df.distinct().count() == 1234 and d.metadata["truncated"] is False
