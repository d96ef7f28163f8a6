"""Mergeable column metrics.

Texts and numbers are read in long form, (column, value), and aggregated by column; texts from their
frequencies, where these are there. The map side
collapses a partition to one row per column, so hardly anything is shuffled, and the generated
code stays small enough to be compiled however wide the tables are.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.dataset import DATE, OTHER, TEXT, ColumnRef, Dataset, text_form
from tableprobe.functions import text
from tableprobe.functions.sql import listed, records
from tableprobe.functions.wordlists import DATE_NAME_PARTS, SENSITIVE_NAME_PARTS

# So many columns are turned into rows by one scan; wider tables take a pruned scan per batch.
BATCH = 100

# The collation under which only equal bytes are equal texts.
BINARY = "UTF8_BINARY"

CODES = range(text.EMPTY, text.WORDS + 1)
MOMENTS = ("mean", "std", "skew", "min", "max", "finite_min", "finite_max")


def named_sensitive(name: str) -> bool:
    return any(part in name.lower() for part in SENSITIVE_NAME_PARTS)


def named_date(name: str) -> bool:
    return any(part in name.lower() for part in DATE_NAME_PARTS)


def column_dimension(spark: SparkSession, refs: list[ColumnRef]) -> DataFrame:
    """One local row per column: what is known from the schemas alone."""
    return spark.createDataFrame(pa.table({
        "cid": pa.array([r.cid for r in refs], pa.int32()),
        "dataset_no": pa.array([r.dataset_no for r in refs], pa.int32()),
        "dataset": pa.array([r.dataset for r in refs], pa.string()),
        "ordinal": pa.array([r.ordinal for r in refs], pa.int32()),
        "column": pa.array([r.name for r in refs], pa.string()),
        "dtype": pa.array([r.dtype for r in refs], pa.string()),
        "kind": pa.array([r.kind for r in refs], pa.string()),
        "named_date": pa.array([named_date(r.name) for r in refs], pa.bool_()),
        "named_sensitive": pa.array([named_sensitive(r.name) for r in refs], pa.bool_()),
    }))


def long_form(datasets: list[Dataset], refs: list[ColumnRef], value) -> DataFrame | None:
    """cid, v: the non-null values of the given columns, `value(ref)` giving a common type."""
    parts = []
    for number, dataset in enumerate(datasets):
        own = [r for r in refs if r.dataset_no == number and r.dtype != "void"]
        for start in range(0, len(own), BATCH):
            batch = own[start:start + BATCH]
            names = [str(r.cid) for r in batch]
            parts.append(
                dataset.df.selectExpr(*[f"{value(r)} AS `{r.cid}`" for r in batch])
                .unpivot([], names, "cid", "v").where("v IS NOT NULL")
                .selectExpr("int(cid) AS cid", "v")
            )
    return reduce(DataFrame.union, parts) if parts else None


def counted_texts(
    datasets: list[Dataset], refs: list[ColumnRef], frequencies: DataFrame | None
) -> DataFrame | None:
    """cid, v, n: values as texts and how often they occur; without frequencies one row a value.

    Frequencies hold texts up to a length as they are, so each distinct one is looked at once. Longer
    texts, of which they hold digests, are read again from the columns that have any. So are numbers, which
    they do not hold as texts, and columns under a collation, whose equal texts may differ.
    """
    if frequencies is None:
        values = long_form(datasets, refs, text_form)
        return None if values is None else values.selectExpr("cid", "v", "1L AS n")
    kept = [r.cid for r in refs if not r.numeric and getattr(r.data_type, "collation", BINARY) == BINARY]
    parts = []
    if kept:
        own = frequencies.where(f"cid IN ({listed(kept)})")
        digest = text.key_is_digest("txt")
        parts.append(own.where(f"NOT {digest}").selectExpr("cid", "txt AS v", "cnt AS n"))
        # One figure a column reaches the driver.
        cut = {r["cid"] for r in own.where(digest).select("cid").distinct().collect()}
        long = long_form(datasets, [r for r in refs if r.cid in cut], text_form)
        if long is not None:
            parts.append(long.where(f"char_length(v) > {text.LITERAL_LIMIT}").selectExpr("cid", "v", "1L AS n"))
    rest = long_form(datasets, [r for r in refs if r.cid not in kept], text_form)
    if rest is not None:
        parts.append(rest.selectExpr("cid", "v", "1L AS n"))
    return reduce(DataFrame.union, parts) if parts else None


def text_metrics(
    datasets: list[Dataset], refs: list[ColumnRef], day_formats: bool = False,
    frequencies: DataFrame | None = None,
) -> DataFrame | None:
    """Counts of value codes, lengths and content tests of texts and of what is read as text.

    Given the frequencies of all columns that are not numeric, they are taken over distinct values.
    With `day_formats` also `hits`, how many values are days in each of the formats.
    """
    read = [r for r in refs if r.kind in (TEXT, OTHER) or (named_date(r.name) and r.kind != DATE)]
    values = counted_texts(datasets, read, frequencies)
    if values is None:
        return None
    judged_by_name = [r.cid for r in read if named_sensitive(r.name) or r.numeric]
    personal = text.has_personal_content("v")
    if judged_by_name:
        personal = f"cid NOT IN ({listed(judged_by_name)}) AND {personal}"
    coded = values.selectExpr("cid", "v", "n", f"{text.strip('v')} AS stripped").selectExpr(
        "cid", "v", "n", "stripped", "char_length(v) AS length", f"{text.value_code('v', 'stripped')} AS code")
    total = "sum(CASE WHEN {} THEN n ELSE 0L END)".format
    formats = ", ".join(total(text.has_day_format("stripped", f)) for f in text.DAY_FORMATS)
    return coded.groupBy("cid").agg(*[F.expr(e) for e in (
        "sum(n) AS texts",
        *[f"{total(f'code = {k}')} AS code{k}" for k in CODES],
        "sum(length * n) AS length_all",
        f"coalesce(sum(CASE WHEN code > {text.BLANK} THEN length * n END), 0) AS length_filled",
        f"bool_or({text.has_bad_character('v')}) AS bad_character",
        f"bool_or({personal}) AS personal_text",
        *([f"array({formats}) AS hits"] if day_formats else []),
    )])


def in_one_format(metrics: DataFrame) -> DataFrame:
    """Text metrics in which only days in their column's most frequent format are days.

    Of formats with equally many hits the first counts. Other days are words, and numbers that are
    days in the compact format only are numbers, unless that format is the one.
    """
    names = list(text.DAY_FORMATS)
    compact = names.index("compact") + 1
    chosen = metrics.selectExpr("*", "array_max(hits) AS dates", "array_position(hits, array_max(hits)) AS place",
                                f"code{text.DAY} + code{text.DAY_NUMBER} AS all_dates")
    moved = {
        text.NUMBER: f"code{text.NUMBER} + if(place = {compact}, 0, code{text.DAY_NUMBER})",
        text.DAY_NUMBER: f"if(place = {compact}, code{text.DAY_NUMBER}, 0)",
        text.DAY: f"if(place = {compact}, 0, dates)",
        text.WORDS: f"code{text.WORDS} + code{text.DAY} - if(place = {compact}, 0, dates)",
    }
    listed_names = ", ".join(f"'{n}'" for n in names)
    return chosen.selectExpr(
        *[c for c in metrics.columns if c not in ("hits", *(f"code{k}" for k in moved))],
        *[f"{e} AS code{k}" for k, e in moved.items()],
        f"if(dates > 0, element_at(array({listed_names}), int(place)), null) AS date_format",
        "dates AS format_dates", "all_dates - dates AS other_dates")


def number_metrics(datasets: list[Dataset], refs: list[ColumnRef]) -> DataFrame | None:
    """Count, moments and range of numbers; NaN is left out of the range."""
    numeric = [r for r in refs if r.numeric]
    values = long_form(datasets, numeric, lambda r: f"cast({r.sql} AS double)")
    if values is None:
        return None
    number = "CASE WHEN NOT isnan(v) THEN v END"
    finite = "CASE WHEN abs(v) < double('infinity') THEN v END"
    return values.groupBy("cid").agg(*[F.expr(e) for e in (
        "count(1) AS numbers",
        "avg(v) AS mean", "stddev_samp(v) AS std", "skewness(v) AS skew",
        f"min({number}) AS min", f"max({number}) AS max",
        f"min({finite}) AS finite_min", f"max({finite}) AS finite_max",
        f"bool_or({text.number_has_personal_content('v')}) AS personal_number",
    )])


def row_counts(datasets: list[Dataset]) -> DataFrame:
    """dataset_no, row_count. Reads no column."""
    return reduce(DataFrame.union, [
        d.df.selectExpr(f"{n} AS dataset_no") for n, d in enumerate(datasets)
    ]).groupBy("dataset_no").agg(F.expr("count(1) AS row_count"))


def presence(datasets: list[Dataset], refs: list[ColumnRef]) -> DataFrame | None:
    """cid, present: non-null values of the columns that are neither texts nor numbers."""
    others = [r for r in refs if not r.numeric and r.kind not in (TEXT, OTHER)]
    values = long_form(datasets, others, lambda r: f"CASE WHEN {r.sql} IS NOT NULL THEN 1 END")
    return None if values is None else values.groupBy("cid").agg(F.expr("count(1) AS present"))


def column_metrics(
    datasets: list[Dataset], refs: list[ColumnRef], dominant_format: bool = False,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """One row per column of every dataset. All joined sides have one row per column.

    With `dominant_format` one date format is chosen a column, from counts of the same scan. With the
    frequencies of the columns that are not numeric, texts are judged once for each distinct value.
    """
    spark = datasets[0].df.sparkSession
    joined = column_dimension(spark, refs).join(row_counts(datasets), "dataset_no", "left")
    texts = text_metrics(datasets, refs, dominant_format, frequencies)
    if texts is not None and dominant_format:
        texts = in_one_format(texts)
    for part in (presence(datasets, refs), texts, number_metrics(datasets, refs)):
        if part is not None:
            joined = joined.join(part, "cid", "left")

    def known(name: str, default: str) -> str:
        return f"coalesce({name}, {default})" if name in joined.columns else default

    return joined.selectExpr(
        "cid", "dataset_no", "dataset", "ordinal", "column", "dtype", "kind", "named_date",
        "named_sensitive", "coalesce(row_count, 0L) AS row_count",
        f"CASE WHEN kind IN ('whole', 'real') THEN {known('numbers', '0L')} "
        f"WHEN kind IN ('text', 'other') THEN {known('texts', '0L')} "
        f"ELSE {known('present', '0L')} END AS non_null",
        *[f"{known(c, '0L')} AS {c}"
          for c in (*[f"code{k}" for k in CODES], "length_all", "length_filled")],
        f"{known('bad_character', 'false')} AS bad_character",
        f"{known('personal_text', 'false')} OR {known('personal_number', 'false')} "
        "AS personal_content",
        *[f"{c if c in joined.columns else 'cast(null AS double)'} AS {c}" for c in MOMENTS],
        *(["date_format", "format_dates", "other_dates"] if "date_format" in joined.columns else []),
    )
