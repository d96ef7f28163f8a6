"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has a bit set where more than half of the 64-bit hashes of its shingles have
it. Fingerprints within `DISTANCE` bits are linked, and the connected groups are found.

Equal fingerprints are merged first. Candidates share some blocks of bits: of `b` blocks, two
fingerprints that differ in 4 bits agree on `b - 4` at least, so no link is lost; `b` follows the
number of fingerprints, so that buckets stay small. A bucket of over `CHUNK` fingerprints is dealt
out as pairs of chunks, each a task's small group. Within a group each fingerprint has its table of
Hamming distances to fixed reference fingerprints; as these can differ by at most the distance of
the two, pairs with a larger coordinate difference are discarded, and survivors are verified. A
group yields the links of its own spanning forest, never all its pairs, and groups are joined by
large-star and small-star steps over tables in the shared folder.

A null text is empty, a text without words has the fingerprint zero, linked like any other. Null
ids count in no minimum: a group of null ids alone has a null component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, utf8

#: Words of a shingle.
SHINGLE = 4
#: Fingerprints at so few differing bits are linked.
DISTANCE = 4
#: Reference fingerprints of the distance table.
PIVOTS = 32
#: Fingerprints of a bucket that are compared in one group; larger buckets are dealt out.
CHUNK = 1000
#: Shingles whose bits are unpacked at once.
STEP = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, unsigned."""
    words = text.lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    flat = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], 42) for a, b in zip(
        starts[:len(words) - last].tolist(), stops[last:].tolist(), strict=True)], ">u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        part = hashes[k:k + STEP]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, columns: list, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """These columns, and `fingerprint` as a signed long."""
    rows = documents.select(*columns, F.col(text_col).cast("string").alias("_text_of_row"))
    names = rows.columns[:-1]

    def hashed(batches):
        for batch in slices(batches, "_text_of_row"):
            texts = utf8(batch["_text_of_row"]).cast(pa.large_binary()).to_pylist()
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([*(batch[c] for c in names), pa.array(found)], [*names, "fingerprint"])

    return rows.mapInArrow(hashed, rows.select(*names).schema.add("fingerprint", "long"))


def block_keys(values: np.ndarray, blocks: int, distance: int = DISTANCE) -> list[np.ndarray]:
    """For each choice of `blocks - distance` blocks of bits, a number from these bits of each value."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = np.full(len(values), number, np.uint64)
        for k in chosen:
            width = np.uint64(edges[k + 1] - edges[k])
            part = (values >> np.uint64(edges[k])) & ((np.uint64(1) << width) - np.uint64(1))
            key = (key << width) | part
        keys.append(key)
    return keys


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """The fewest blocks with which a bucket of evenly spread fingerprints holds 64 of them at most."""
    blocks = distance + 1
    while blocks < distance + 4 and 2 ** (64 * (blocks - distance) / blocks) * 64 < count:
        blocks += 1
    return blocks


PIVOT_VALUES = np.random.default_rng(20).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def links(values: np.ndarray, groups: np.ndarray, sides: np.ndarray, distance: int = DISTANCE) -> tuple:
    """Spanning forests of the links within groups; equal group numbers stand together.

    `sides` is 0 where all pairs of a group count; else only pairs of a 1 and a 2 do.
    """
    table = np.bitwise_count(values[:, None] ^ PIVOT_VALUES[None, :]).astype(np.int8)
    first, second = [], []
    alive = np.arange(len(values))
    for shift in range(1, len(values)):
        alive = alive[:np.searchsorted(alive, len(values) - shift)]
        alive = alive[groups[alive] == groups[alive + shift]]
        if not len(alive):
            break
        a, b = alive, alive + shift
        both = (sides[a] == 0) | (sides[a] != sides[b])
        a, b = a[both], b[both]
        for pivot in range(0, PIVOTS, 8):
            near = np.abs(table[a, pivot:pivot + 8] - table[b, pivot:pivot + 8]).max(1, initial=0) <= distance
            a, b = a[near], b[near]
        true = np.bitwise_count(values[a] ^ values[b]) <= distance
        first.append(a[true])
        second.append(b[true])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
    # Each node's label is its root. The larger root of a link goes below the smaller, of several below
    # the least, and a link is done only when its ends have one root.
    label = np.arange(len(values))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def near_links(values: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect all of these distinct fingerprints within the distance; not all links."""
    blocks = blocks_for(values.count(), distance)

    def keyed(batches):
        for batch in batches:
            found = batch["fingerprint"].to_numpy().view(np.uint64)
            keys = block_keys(found, blocks, distance)
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)),
                                   pa.array(np.tile(found.view(np.int64), len(keys)))], ["key", "value"])

    rows = values.select("fingerprint").mapInArrow(keyed, "key long, value long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    rows = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("many") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")
    rows = rows.select("key", "value", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       side.cast("int").alias("side"), "value")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "value")

    def linked(batches):
        held = None
        for batch in batches:
            new = [batch[c].to_numpy() for c in ("key", "i", "j", "side", "value")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            number = starts_of(held)
            whole = np.searchsorted(number, number[-1])  # the last group may go on
            if whole:
                yield forest([x[:whole] for x in held], number[:whole])
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield forest(held, starts_of(held))

    def starts_of(held):
        changes = np.zeros(len(held[0]), bool)
        for x in held[:3]:
            changes[1:] |= x[1:] != x[:-1]
        return np.cumsum(changes)

    def forest(held, number):
        u, v = links(held[4].view(np.uint64), number, held[3], distance)
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return rows.mapInArrow(linked, "u long, v long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with edges: root is the smallest node of its connected group."""
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = staged(small)
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """One row a document: `doc`, `mark` (hash of its text), `fingerprint` (long), `root`, the
    fingerprint that stands for its group, and `component`, the smallest id that links reach from it,
    itself included."""
    found = staged(fingerprints(documents, [F.col(id_col).alias("doc"), F.xxhash64(
        F.col(text_col).cast("string")).alias("mark")], text_col, shingle))
    values = staged(found.groupBy("fingerprint").agg(F.min("doc").alias("doc")))
    roots = stars(near_links(values, distance))
    placed = values.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "doc", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component"))
    component = placed.join(least, "root").select("fingerprint", "root", "component")
    return found.join(component, "fingerprint").select("doc", "mark", "fingerprint", "root", "component")


def deduplicate_near(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     distance: int = DISTANCE) -> DataFrame:
    """The first document of each group: smallest id (null last), then smallest hash of the text."""
    groups = near_groups(documents, id_col, text_col, shingle, distance)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")).alias("b"))
    best = best.select(F.col("b.doc").alias("best_doc"), F.col("b.mark").alias("best_mark"))
    mark = F.xxhash64(F.col(text_col).cast("string"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            F.col(id_col).alias("doc"), mark.alias("mark"))
    kept = rows.join(best, F.col("doc").eqNullSafe(F.col("best_doc")) & (F.col("mark") == F.col("best_mark")), "left_semi")
    return kept.dropDuplicates(["doc", "mark"]).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
