"""Substring dedup: repeated windows of words, found through a count-min prefilter.

Words are `[^\\x20\\x09-\\x0D]+`, a window is `WINDOW` consecutive words of one text. A word goes if a
window that covers it also starts in a document with a smaller id; windows are judged on the input.

First pass: each window is stood for by the least hash among its runs of `GRAM` words, so equal
windows, in whichever text, have equal stand-ins, and neighbouring windows mostly share one. Each
task counts the stand-ins in a count-min sketch whose counters stop at two; the sketches merge block
by block in the shuffle, into a bitmap of fixed size (`ROWS` x `CELLS` bits, 32 MB by default), which
is broadcast. Estimates are never too low. Second pass: only windows estimated to be repeated are
grouped, exactly, by 96 bits of hash; a task first keeps one row a window for each of its slices of
text, so that a passage in very many documents meets as many rows as there are slices, not
documents. Groups are read as a sorted stream and never held.

Beyond the size that the sketch can tell apart the prefilter lets more through; the result is the
same. Texts equal to one with a smaller id are settled by their digest before that.

Null texts have no words. Rows without an id are left as they are and remove nothing. Rows of one
id do not remove each other's words.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import owners, slices, staged, utf8, white_words

#: Words of a window.
WINDOW = 13
#: Words of a run that stands for the windows around it.
GRAM = 8
#: Rows of the sketch, and cells of a row, a power of two of at least 2^16.
ROWS, CELLS = 2, 1 << 27
BLOCK = 1 << 16
#: Stand-ins that a task gathers before it sends its sketch.
GATHERED = 2_000_000
#: At most so many rows that repeat an earlier text (about 24 bytes each) are broadcast.
BROADCAST_COPIES = 1_000_000

_random = np.random.default_rng(13)
FACTORS = _random.integers(0, 2**64, (2, 64), dtype=np.uint64) | np.uint64(1)
SEEDS = _random.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word, 2 x n."""
    codes = pc.dictionary_encode(words)
    kinds = codes.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, kinds)), "<u8").reshape(-1, 2)
    return table[codes.indices.to_numpy()].T


def runs(hashes: np.ndarray, length: int, which: int) -> np.ndarray:
    """A hash of each run of this many words, across texts too."""
    n = max(0, len(hashes) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += hashes[k:k + n] * FACTORS[which, k]
    return mixed(total)


def windows(texts: pa.Array, window: int = WINDOW) -> tuple:
    """For each window of the texts: its text, its first word there, two hashes, its stand-in; and the
    words of each text."""
    words, counts = white_words(texts)
    doc = owners(counts)
    first = np.cumsum(counts) - counts
    n = max(0, len(words) - window + 1)
    inside = np.flatnonzero(doc[:n] == doc[len(doc) - n:]) if n else np.zeros(0, np.int64)
    if not len(inside):
        none = np.zeros(0, np.uint64)
        return inside, inside, none, none, none, counts
    one, two = word_hashes(words)
    gram = min(GRAM, window)
    parts = runs(one ^ two, gram, 0)
    least = parts[:n].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, parts[k:k + n], out=least)
    own = doc[inside]
    return (own, inside - first[own], runs(one, window, 0)[inside], runs(two, window, 1)[inside], least[inside], counts)


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(keys * SEEDS[row]) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def stand_ins(texts: pa.Array, window: int) -> np.ndarray:
    """Stand-ins of the windows of the texts; of neighbours with the same, one."""
    own, _, _, _, least, _ = windows(texts, window)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
    return least[new]


def sketch(documents: DataFrame, keys_of, cells: int) -> np.ndarray:
    """The merged sketch of the keys of the table's texts (column `text`), an array of which `keys_of`
    gives: a bit for each counter that is two."""
    rows_ = ROWS

    def blocks(gathered: list) -> pa.RecordBatch:
        keys = np.concatenate(gathered) if gathered else np.zeros(0, np.uint64)
        names, parts = [], []
        for row in range(rows_):
            found = np.sort(cells_of(keys, row, cells))
            found = found[np.concatenate([np.ones(min(2, len(found)), bool), found[2:] != found[:-2]])]  # two of each at most
            cuts = np.flatnonzero(np.diff(found >> 16, prepend=-1))
            for a, b in pairwise([*cuts, len(found)]):
                names.append(row * (cells // BLOCK) + int(found[a] >> 16))
                parts.append((found[a:b] & (BLOCK - 1)).astype("<u2").tobytes())
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["block", "cells"])

    def counted(batches):
        gathered, many = [], 0
        for batch in slices(batches):
            gathered.append(keys_of(utf8(batch["text"])))
            many += len(gathered[-1])
            if many > GATHERED:
                yield blocks(gathered)
                gathered, many = [], 0
        if many:
            yield blocks(gathered)

    def merged(batches):
        block, counts = None, None

        def done():
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(counts >= 2).tobytes()])],
                                   ["block", "bits"])

        for batch in batches:
            for name, part in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                if name != block:
                    if block is not None:
                        yield done()
                    block, counts = name, np.zeros(BLOCK, np.int32)
                counts += np.bincount(np.frombuffer(part, "<u2"), minlength=BLOCK).astype(np.int32)
        if block is not None:
            yield done()

    parts = documents.select("text").mapInArrow(counted, "block long, cells binary")
    whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block long, bits binary").toArrow()
    bits = np.zeros(rows_ * cells // 8, np.uint8)  # the fixed size of the sketch
    for block, part in zip(whole["block"].to_pylist(), whole["bits"].to_pylist(), strict=True):
        bits[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)] = np.frombuffer(part, np.uint8)
    return bits


def repeated(bits: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Whether the sketch's estimate for each key is two."""
    found = np.ones(len(keys), bool)
    for row in range(ROWS):
        at = cells_of(keys, row, cells) + row * cells
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found


def repeated_windows(documents: DataFrame, window: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """Starts of windows that also start in a document with a smaller id, of a table (doc, mark, text)
    whose ids are not null: doc, mark, and the starts as little-endian 32-bit numbers, in several rows."""
    shared = documents.sparkSession.sparkContext.broadcast(sketch(documents, lambda texts: stand_ins(texts, window), cells))

    def candidates(batches):
        for batch in slices(batches):
            own, start, one, two, least, _ = windows(utf8(batch["text"]), window)
            some = np.flatnonzero(repeated(shared.value, least, cells))
            doc, mark = batch["doc"].to_numpy()[own[some]], batch["mark"].to_numpy()[own[some]]
            one, two, start = one[some], two[some] >> np.uint64(32), start[some]
            # One row a window goes on, that of the smallest id; the others are settled by it, or tie with it.
            order = np.lexsort((start, mark, doc, two, one))
            one, two, doc, mark, start = one[order], two[order], doc[order], mark[order], start[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else doc
            yield pa.record_batch(
                [pa.array(one.view(np.int64)), pa.array(two.astype(np.int64)), pa.array(doc), pa.array(mark),
                 pa.array(start.astype(np.int64)), pa.array(doc > lead)], ["one", "two", "doc", "mark", "start", "late"])

    found = staged(documents.mapInArrow(candidates, "one long, two long, doc long, mark long, start long, late boolean"))
    # Ties at the smallest id of a slice go on too, as many as one document repeats the window.
    open_ = found.where("not late").drop("late")
    rows = open_.repartition("one").sortWithinPartitions("one", "two", "doc")

    def settled(batches):
        last = None
        for batch in batches:
            one, two, doc = (batch[c].to_numpy() for c in ("one", "two", "doc"))
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            if last and len(one) and last[:2] == (one[0], two[0]):
                lead[:int(np.argmax(new[1:])) + 1 if new[1:].any() else len(one)] = last[2]
            if len(one):
                last = (one[-1], two[-1], lead[-1])
            yield from packed(doc, batch["mark"].to_numpy(), batch["start"].to_numpy(), doc > lead)

    def local(batches):
        for batch in batches:
            doc = batch["doc"].to_numpy()
            yield from packed(doc, batch["mark"].to_numpy(), batch["start"].to_numpy(), np.ones(len(doc), bool))

    def packed(doc, mark, start, late):
        """One row for each text of a batch."""
        order = np.flatnonzero(late)
        order = order[np.lexsort((start[order], mark[order], doc[order]))]
        doc, mark, flat = doc[order], mark[order], start[order].astype("<i4")
        cuts = np.flatnonzero((np.diff(doc, prepend=0) != 0) | (np.diff(mark, prepend=0) != 0) | (np.arange(len(doc)) == 0))
        parts = [flat[a:b].tobytes() for a, b in pairwise([*cuts, len(doc)])]
        yield pa.record_batch([pa.array(doc[cuts]), pa.array(mark[cuts]), pa.array(parts, pa.binary())],
                              ["doc", "mark", "starts"])

    schema = "doc long, mark long, starts binary"
    return rows.mapInArrow(settled, schema).unionByName(
        found.where("late").select("doc", "mark", "start").mapInArrow(local, schema))


def deduplicate_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                           cells: int = CELLS, columns: list[str] | None = None) -> DataFrame:
    """These columns of the table, all by default, with `n_words`, `n_removed` and `kept_text`, the kept
    words joined by a space, in place of columns of these names. Ids must be whole numbers."""
    new = ("n_words", "n_removed", "kept_text")
    names = [c for c in columns or documents.columns if c not in new]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                            F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    digest = [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2")]
    rows = rows.select("*", *digest).withColumn("mark", F.pmod("d1", F.lit(1 << 31)))
    # Texts that repeat one with a smaller id: every window of theirs does.
    prints = rows.where("doc is not null").groupBy("d1", "d2", "doc").count()
    least = prints.groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.count("*").alias("many")).where("many > 1")
    copies = staged(prints.join(least, ["d1", "d2"]).where("doc > least").select("d1", "d2", "doc", F.lit(True).alias("copy")))
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    marked = rows.join(copies, ["d1", "d2", "doc"], "left")
    found = repeated_windows(marked.where("copy is null and doc is not null").select("doc", "mark", "text"), window, cells)
    starts = found.groupBy(F.col("doc").alias("its_doc"), F.col("mark").alias("its_mark")).agg(
        F.collect_list("starts").alias("starts"))
    whole = marked.join(starts, (F.col("doc") == F.col("its_doc")) & (F.col("mark") == F.col("its_mark")), "left").select(
        "row", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")

    def cut(batches):
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for body, copy, found in zip(batch["text"].to_pylist(), batch["copy"].to_pylist(),
                                         batch["starts"].to_pylist(), strict=True):
                words = body.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for part in found or ():
                    at = np.frombuffer(part, "<i4")
                    np.add.at(gone, at, 1)
                    np.subtract.at(gone, at + window, 1)
                gone = np.cumsum(gone[:-1]) > 0 if not copy else np.full(len(words), len(words) >= window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()
                            if n_removed[-1] else b" ".join(words).decode())
            yield pa.record_batch([batch["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                   pa.array(kept, pa.string())], ["row", *new])

    schema = whole.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return whole.mapInArrow(cut, schema).select("row.*", *new)
