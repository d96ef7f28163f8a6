"""Value frequencies: the one intermediate that is shuffled by value.

Columns of one physical type are grouped together with a typed key, so the map side collapses
repeats before the shuffle and hot values cost one row per task. Long texts travel as keys of
bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.dataset import OTHER, REAL, TEXT, WHOLE, ColumnRef, Dataset, text_form
from tableprobe.functions import text
from tableprobe.functions.sql import listed
from tableprobe.operators.metrics import long_form

# Text to show for a row of the frequency table.
DISPLAY = "coalesce(txt, string(whole), string(num))"

VALUE_ORDER = "whole, num, txt"

FREQUENCIES = "cid int, num double, whole bigint, txt string, cnt bigint"


def value_frequencies(datasets: list[Dataset], refs: list[ColumnRef]) -> DataFrame:
    """cid, num, whole, txt, cnt: how often each distinct non-null value occurs.

    Numbers are held in `num` (and exactly in `whole` if integral), all else in `txt`.
    """
    by_type: dict[tuple[str, str], list[ColumnRef]] = defaultdict(list)
    for ref in refs:
        by_type[_branch(ref)].append(ref)
    counted = [_count(datasets, *branch, group) for branch, group in by_type.items()]
    found = [c for c in counted if c is not None]
    if not found:
        return datasets[0].df.sparkSession.createDataFrame([], FREQUENCIES)
    return reduce(DataFrame.union, found)


def _branch(ref: ColumnRef) -> tuple[str, str]:
    if ref.kind == WHOLE:
        return WHOLE, "bigint"
    if ref.kind == REAL:
        return REAL, ref.dtype if ref.dtype.startswith("decimal") else "double"
    if ref.kind in (TEXT, OTHER):
        return TEXT, "string"
    return ref.kind, ref.dtype


def _count(
    datasets: list[Dataset], kind: str, key_type: str, refs: list[ColumnRef]
) -> DataFrame | None:
    def key(ref: ColumnRef) -> str:
        if kind == TEXT:
            return text.frequency_key(text_form(ref))
        return f"cast({ref.sql} AS {key_type})"

    values = long_form(datasets, refs, key)
    if values is None:
        return None
    counted = values.groupBy("cid", "v").agg(F.expr("count(1) AS cnt"))
    number = "double(v)" if kind in (WHOLE, REAL) else "cast(null AS double)"
    whole = "v" if kind == WHOLE else "cast(null AS bigint)"
    shown = kind not in (WHOLE, REAL) or key_type.startswith("decimal")
    return counted.selectExpr(
        "cid", f"{number} AS num", f"{whole} AS whole",
        f"{'string(v)' if shown else 'cast(null AS string)'} AS txt", "cnt",
    )


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    """cid, distinct_values, top_count."""
    return frequencies.groupBy("cid").agg(
        F.expr("count(1) AS distinct_values"), F.expr("max(cnt) AS top_count"))


def normalised_counts(frequencies: DataFrame, text_cids: list[int]) -> DataFrame:
    """cid, distinct_normalised: distinct values once case and white space are ignored."""
    own = frequencies.where(f"cid IN ({listed(text_cids)})" if text_cids else "false")
    return (
        own.selectExpr("cid", f"{text.normalised_key('txt')} AS norm").distinct()
        .groupBy("cid").agg(F.expr("count(1) AS distinct_normalised"))
    )


class Texts:
    """The whole texts behind the keys of frequency tables."""

    def __init__(self, datasets: list[Dataset], refs: list[ColumnRef]):
        self.datasets, self.refs = datasets, [r for r in refs if r.kind in (TEXT, OTHER)]

    def restore(self, rows: DataFrame) -> DataFrame:
        """A frequency table with whole texts in place of keys.

        One more pass over the texts beyond the limit, joined to the keys in question.
        """
        texts = long_form(self.datasets, self.refs, text_form)
        if texts is None:
            return rows
        keys = rows.where(text.key_is_digest("txt")).select("cid", "txt").distinct()
        found = (
            texts.where(f"char_length(v) > {text.LITERAL_LIMIT}")
            .selectExpr("cid", "v AS whole_text", f"{text.frequency_key('v')} AS txt")
            .join(keys, ["cid", "txt"]).groupBy("cid", "txt").agg(F.expr("first(whole_text) AS whole_text"))
        )
        return rows.join(found, ["cid", "txt"], "left").withColumn(
            "txt", F.coalesce("whole_text", "txt")).drop("whole_text")


def ranked_values(
    frequencies: DataFrame, texts: Texts, limit: int | None, by_count: bool = True
) -> DataFrame:
    """The first `limit` values per column (all for None), by falling count or by value alone.

    The rank filter is applied before the shuffle too, so a task gets a few rows per column and
    map partition, however many distinct values there are. Long texts that might be among the
    first, judged by their start, are fetched whole; order and result go by the whole value.
    """
    counted = "cnt DESC, " if by_count else ""
    near = frequencies
    if limit is not None:
        near = frequencies.selectExpr(
            "*", f"rank() OVER (PARTITION BY cid ORDER BY {counted}whole, num, "
            f"substring(txt, 1, {text.KEY_PREFIX})) AS near").where(f"near <= {limit}").drop("near")
    ranked = texts.restore(near).selectExpr(
        "*", f"row_number() OVER (PARTITION BY cid ORDER BY {counted}{VALUE_ORDER}) AS rank")
    return ranked if limit is None else ranked.where(f"rank <= {limit}")
