"""Records of delimited text whose quoted cells may hold line breaks, read by many tasks.

A line of a file does not tell whether it starts inside a quoted cell. What it does tell is where it ends
for either answer: a map from the state at its start to the state at its end. The maps of a task's lines
compose to one map for its byte range, and the maps of the ranges, one small row each, give the state in
which every range starts. With that known, each task cuts its own lines into records; of a record that runs
over the end of a range the pieces are put together by the position of their ranges.

States: 0 outside a quoted cell, 1 inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprobe.staging import Stage

#: Pieces of a record in a byte range: its end, a whole range inside it, its beginning.
END, MIDDLE, BEGINNING = 0, 1, 2


@dataclass(frozen=True)
class Ranges:
    """What one pass over all lines tells: `inside` has, for each byte range (file, first byte), the state in
    which it starts; `crossed` if one ends inside a cell."""

    inside: dict[tuple[int, int], int]
    crossed: bool
    utf8: bool
    spanning: bool


def quoted_cell() -> str:
    """Pattern of a quoted cell; doubled quotes stand for one."""
    return '"[^"]*+(?:""[^"]*+)*+"'


def open_end(separator: str) -> str:
    """Pattern of a line that starts outside of quotes and ends inside: cells that end at a separator, then
    one whose quote is not closed. A quote counts at the start of a cell alone."""
    s = re.escape(separator)
    return rf'^(?:(?:{quoted_cell()}[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"[^"]*+(?:""[^"]*+)*+\z'


def cell_count(text: str, separator: str) -> str:
    """SQL for the number of cells of a record."""
    s = re.escape(separator)
    pattern = f"(^|{s}){quoted_cell()}".replace("\\", "\\\\").replace("'", "\\'")
    bare = f"regexp_replace({text}, '{pattern}', '$1')"
    return f"(1 + length({bare}) - length(replace({bare}, '{separator}', '')))"


def lines_of(spark: SparkSession, path: str, separator: str, encoding: str | None = None) -> DataFrame:
    """file, start, value, out, in_: the lines in order of each byte range, and the states (as truth values)
    in which a line ends that starts outside and inside."""
    quote, pattern = F.contains("value", F.lit('"')), open_end(separator)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = lines.select(
        "*", (quote & F.col("value").rlike(pattern)).alias("out"),
        (~quote | F.concat(F.lit('"'), "value").rlike(pattern)).alias("in_"))
    # The reader keeps the bytes; only other encodings need a translation.
    return lines if encoding in (None, "UTF-8") else lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def states_after(out: np.ndarray, in_: np.ndarray, state: int) -> np.ndarray:
    """The state after each line, the first starting in `state`."""
    places = np.arange(len(out))
    swaps = np.cumsum(out & ~in_)
    fixed = np.maximum.accumulate(np.where(out == in_, places, -1))  # the last line that ends alike either way
    since = swaps - np.where(fixed >= 0, swaps[fixed], 0)
    return (np.where(fixed >= 0, out[fixed], bool(state)) ^ (since % 2 == 1)).astype(np.int8)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Parts of a batch that come from one byte range."""
    file, start = batch["file"].to_numpy(), batch["start"].to_numpy()
    edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *edges], [*edges, len(file)], strict=True):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("out", "in_"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each byte range: its map, and what its lines have."""
    seen: dict[tuple[int, int], list] = {}
    for batch in batches:
        for key, part in runs(batch):
            out, in_ = flags(part)
            known = seen.setdefault(key, [0, 1, 0, False, False, False])
            known[0], known[1] = (int(states_after(out, in_, s)[-1]) for s in known[:2])
            known[2] += len(out)
            for place, now in enumerate((out, *(part[c].to_numpy(zero_copy_only=False) for c in ("invalid", "carriage"))), 3):
                known[place] = known[place] or bool(now.any())
    if seen:
        keys, facts = zip(*seen.items(), strict=True)
        columns = [*zip(*keys, strict=True), *zip(*facts, strict=True)]
        yield pa.record_batch([pa.array(c) for c in columns], ["file", "start", "out", "in_", "lines", "opens", "invalid", "carriage"])


def survey(spark: SparkSession, path: str, separator: str) -> Ranges:
    """The states in which byte ranges start, whether all lines are UTF-8, and whether any record spans lines.

    One pass, in which only truth values leave the JVM. The driver gets one row for each byte range.
    """
    lines = lines_of(spark, path, separator)
    narrow = lines.select(
        "file", "start", "out", "in_", F.expr("NOT is_valid_utf8(value)").alias("invalid"),
        F.expr(r"instr(value, '\r') BETWEEN 1 AND length(value) - 1").alias("carriage"))
    found = narrow.mapInArrow(_summed, "file bigint, start bigint, out bigint, in_ bigint, lines bigint, "
                                       "opens boolean, invalid boolean, carriage boolean").collect()
    inside, state, last, crossed = {}, 0, None, False
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        state = state if r.file == last else 0
        inside[(r.file, r.start)] = state
        state, last = (r.in_ if state else r.out), r.file
        crossed = crossed or state == 1
    # Files without line feeds end their lines otherwise; Spark's reader knows how.
    other_ends = all(r.lines <= 1 for r in found) and any(r.carriage for r in found)
    return Ranges(inside, crossed, not any(r.invalid for r in found), any(r.opens for r in found) and not other_ends)


class _Cutter:
    """Cuts the lines of byte ranges into records, in order."""

    def __init__(self, inside: dict[tuple[int, int], int], header: bool, pieces: bool):
        self.inside, self.header, self.pieces = inside, header, pieces
        self.key, self.state, self.head, self.held, self.skip = None, 0, False, [], False

    def begin(self, key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        yield from self.end()
        if key not in self.inside:
            raise RuntimeError("the files were split otherwise than in the survey; read them again")
        self.key, self.state = key, self.inside[key]
        self.head, self.skip = self.state == 1, self.header and key[1] == 0

    def end(self) -> Iterator[pa.RecordBatch]:
        """What is left at the end of a byte range belongs to a record that goes on."""
        if self.held:
            yield from self.given_piece(MIDDLE if self.head else BEGINNING)

    def given_piece(self, role: int) -> Iterator[pa.RecordBatch]:
        text = "\n".join(v.as_py() for part in self.held for v in part)
        self.held = []
        if self.pieces:
            yield pa.record_batch([pa.array([self.key[0]]), pa.array([self.key[1]]), pa.array([role], pa.int32()),
                                   pa.array([text])], ["file", "start", "role", "value"])

    def given(self, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """Whole records, without blank ones and, at the start of a file, the header."""
        texts = texts.filter(pc.not_equal(pc.utf8_trim_whitespace(texts), ""))
        if self.skip and len(texts):
            texts, self.skip = texts.slice(1), False
        if len(texts) and not self.pieces:
            yield pa.record_batch([texts], ["value"])

    def lines(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value = part["value"]
        after = states_after(*flags(part), self.state)
        before = np.concatenate([[self.state], after[:-1]])
        self.state = int(after[-1])
        starts = np.flatnonzero(before == 0)
        lead = int(starts[0]) if len(starts) else len(after)
        if lead:  # the record that was open goes on
            self.held.append(value.slice(0, lead))
            if after[lead - 1] == 0:
                if self.head:
                    yield from self.given_piece(END)
                else:
                    text = "\n".join(v.as_py() for held in self.held for v in held)
                    self.held = []
                    yield from self.given(pa.array([text]))
                self.head = False
        if not len(starts):
            return
        if self.state:  # the last record stays open
            self.held = [value.slice(int(starts[-1]))]
            stops = starts
        else:
            stops = np.append(starts, len(after))
        if len(stops) > 1:
            plain = value.slice(lead, int(stops[-1]) - lead)
            if len(stops) - 1 == len(plain):
                yield from self.given(plain)
            else:
                offsets = pa.array(stops - lead, pa.int32())
                yield from self.given(pc.binary_join(pa.ListArray.from_arrays(offsets, plain), "\n"))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, part in runs(batch):
                if key != self.key:
                    yield from self.begin(key)
                yield from self.lines(part)
        yield from self.end()


def records(spark: SparkSession, path: str, separator: str, encoding: str, ranges: Ranges, header: bool) -> DataFrame:
    """value: the texts of all records, without blank ones and, if `header`, without the first of each file."""
    lines = lines_of(spark, path, separator, encoding)
    whole = lines.mapInArrow(_Cutter(ranges.inside, header, False), "value string")
    if ranges.crossed:
        # At most two pieces a byte range: the end of one record, the beginning of another.
        pieces = Stage(spark).table("pieces", lambda: lines.mapInArrow(
            _Cutter(ranges.inside, header, True), "file bigint, start bigint, role int, value string"))
        order = Window.partitionBy("file").orderBy("start", "role")
        number = F.sum((F.col("role") == BEGINNING).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        joined = pieces.withColumn("number", number).groupBy("file", "number").agg(
            F.sort_array(F.collect_list(F.struct("start", "role", "value"))).alias("parts"))
        whole = whole.unionByName(joined.select(F.array_join(F.transform("parts", lambda p: p.value), "\n").alias("value")))
    return whole.select(F.expr("CASE WHEN endswith(value, '\\r') THEN left(value, length(value) - 1) ELSE value END").alias("value"))
