"""Helpers that several operators share: staged tables, bounded slices of Arrow batches, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds at once; a longer single text is one step.
SLICE = 4 << 20

#: Rows of a range of ids, and most ranges, in `with_next`.
RANGE, RANGES = 2_000, 2_000

#: Spark's setting that a finished query deletes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where it is unset, in local mode only, one of our own."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_root = _own_root or tempfile.mkdtemp(prefix="tableprobe-llm-")
    return _own_root


def staged(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: lineage ends there, and a lost
    executor loses nothing. The shuffle files that led to it are deleted once it is written, not when the
    driver next collects its garbage."""
    path = f"{shared_root(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete staged tables, for which everything that reads them must be staged itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def utf8(values: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets; a null is empty."""
    return pc.fill_null(values.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches that hold at most `limit` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(size):
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of `utf8`, both starting at zero."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def white_words(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(values)
    parts = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    full = pc.greater(pc.binary_length(parts), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return parts.filter(full), np.diff(ends[offsets])


def owners(counts: np.ndarray) -> np.ndarray:
    """For each element of groups of these sizes, the number of its group."""
    return np.repeat(np.arange(len(counts)), counts)


def lower_ascii(column):
    """A-Z in lower case, all else unchanged."""
    plain = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # `lower` says the same of pure ASCII, faster.
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(plain)


def with_next(rows: DataFrame, key: str, tie: str, columns: dict[str, str]) -> DataFrame:
    """The rows and, as new columns {new: old}, values of the next row by (key, tie), nulls first; the
    first row follows the last.

    Keys, whole numbers, are cut into ranges by approximate quantiles, each range is sorted by itself,
    and its last row is followed by the first of the next range. Only the cuts and the ranges' least
    keys, at most `RANGES` of each, reach the driver.
    """
    many, none, top = rows.agg(F.count("*"), F.count_if(F.col(key).isNull()), F.max(key)).first()
    ranges = max(1, min(RANGES, many // RANGE))
    cuts = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    cuts = [c for c in sorted(set(cuts or [])) if c < top]
    span = F.lit(0)
    if cuts:  # the number of cuts below the key; the key of a cut ends its range
        listed = F.from_json(F.lit(str(cuts)), "array<bigint>")
        span = F.size(F.filter(listed, lambda c: c < F.col(key)))
    placed = rows.withColumn("_span", F.when(F.col(key).isNull(), -1).otherwise(span).cast("int"))
    heads = sorted(placed.groupBy("_span").agg(F.min(key)).collect())
    numbers = [h[0] for h in heads]
    follows = [(h[0], h[1], numbers[k - 1]) for k, h in enumerate(heads)]  # after the last comes the first
    least = rows.sparkSession.createDataFrame(follows, "_its int, _head bigint, _before int")
    first = placed.join(F.broadcast(least), (F.col("_span") == F.col("_its")) & F.col(key).eqNullSafe(F.col("_head")))
    first = first.groupBy("_before").agg(F.min(F.struct(F.col(tie).alias("tie"), *[
        F.col(old).alias(new) for new, old in columns.items()])).alias("_first"))
    order = Window.partitionBy("_span").orderBy(F.col(key).asc_nulls_first(), tie)
    inner = placed.select("*", F.lead(F.struct(*[F.col(old).alias(new) for new, old in columns.items()])).over(order).alias("_next"))
    # By the range alone, as the rows lie; only a range's last row takes what is joined.
    joined = inner.join(first, F.col("_span") == F.col("_before"), "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[
        F.coalesce(f"_next.{new}", f"_first.{new}").alias(new) for new in columns])
