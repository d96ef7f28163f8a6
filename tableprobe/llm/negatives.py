"""Hard negatives: exact windows of inner products over candidate blocks in Hilbert order.

Vectors become whole numbers and are sorted along a Hilbert curve over all dimensions (two bits each, the
widest dimension first). Consecutive rows form a block, one row of a Parquet table that holds its vectors and,
as a zone map, the least and the largest entry of each dimension. The anchors of a block form a tile. The
inner product of an anchor with anything in a block lies between two sums of products with the zone map's ends;
by these bounds a tile meets only the blocks that can hold what it looks for: first scores of its label that
reach the best ones of the anchor's own block, then scores inside the windows that the positives open.

Tiles and blocks meet in joins by block, so a task holds one block and one tile at a time. Whatever the copies
of a vector are, blocks and tiles are cut by rows. A task merges what its pairs find for an anchor or window,
so what it gives grows with anchors and tasks, not with pairs; a rank over the tasks' rows keeps the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .whitening import finite_vectors, whole_numbers

#: Rows of a block: at least, at most; between them, so many blocks that bounds stay few.
SMALL, LARGE, WANTED = 512, 4_096, 64
#: Most anchors of a tile, and zone maps that are laid side by side.
TILE, ZONES = 512, 256
#: Entries beyond count as this far, so that inner products over up to 2^14 dimensions fit a long.
FAR = 1 << 24
#: A null id, in its place behind all others.
NO_ID = (1 << 63) - 1
#: Stands for a positive that an anchor does not have; its window holds nothing.
NO_SCORE = -(1 << 62)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve (as bytes, in order) of points of `bits`-bit coordinates, a row each.

    Gray-code rotation of the coordinates, from the highest bit down, then the bits of all dimensions are
    interleaved.
    """
    x = cells.astype(np.uint8).T.copy()
    width = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for k in range(width):
            on = (x[k] & q) != 0
            swapped = (x[0] ^ x[k]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swapped)
            if k:
                x[k] = np.where(on, x[k], x[k] ^ swapped)
        q >>= 1
    for k in range(1, width):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; by floating point where no sum leaves its whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that zone maps allow, for each anchor and zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return inner(up, low) + inner(down, high), inner(up, high) + inner(down, low)


def matrix(values: pa.Array | bytes, width: int) -> np.ndarray:
    return np.frombuffer(values, np.int32).reshape(-1, width).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` highest allowed scores of each row and their columns, ties by the earlier column.

    Where a row has fewer, the scores are `NO_SCORE`.
    """
    rows, width = scores.shape
    if width < count:
        pad = ((0, 0), (0, count - width))
        return best(np.pad(scores, pad), np.pad(allowed, pad), count)
    if width and int(np.abs(scores).max(initial=0)) < (1 << 61) // width:
        # One number tells score and column apart, so that no sorting is needed to find the best.
        told = np.where(allowed, scores * width + np.arange(width - 1, -1, -1), NO_SCORE)
        told = -np.sort(-np.partition(told, width - count, axis=1)[:, width - count:], axis=1)
        return np.where(told == NO_SCORE, NO_SCORE, told // width), width - 1 - told % width
    masked = np.where(allowed, scores, NO_SCORE)
    order = np.argsort(-masked, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(masked, order, 1), order


class Best:
    """The best scores and ids of each anchor and place, over the pairs of tiles and blocks that a task sees.

    Holds about `HELD` of them at most; what would be more is given away before.
    """

    HELD = 2_000_000

    def __init__(self, count: int):
        self.count, self.held, self.cells = count, {}, 0

    def add(self, home: int, tile: int, place: int, scores: np.ndarray, ids: np.ndarray):
        key = (home, tile, place)
        if key in self.held:
            scores, ids = (np.hstack(pair) for pair in zip(self.held[key], (scores, ids), strict=True))
            order = np.lexsort((ids, -scores), axis=1)[:, :self.count]
            scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        else:
            self.cells += scores.size
        self.held[key] = scores, ids
        if self.cells > self.HELD:
            yield from self.given()

    def given(self):
        for (home, tile, place), (scores, ids) in self.held.items():
            r, c = np.nonzero(scores != NO_SCORE)
            if len(r):
                yield pa.record_batch(
                    [pa.array(np.full(len(r), home)), pa.array(np.full(len(r), tile, np.int32)), pa.array(r.astype(np.int32)),
                     pa.array(np.full(len(r), place, np.int32)), pa.array(scores[r, c]), pa.array(ids[r, c])],
                    ["home", "tile", "anchor", "place", "score", "found"])
        self.held, self.cells = {}, 0


FOUND = "home bigint, tile int, anchor int, place int, score bigint, found bigint"


def packed_blocks(candidates: DataFrame, width: int, rows: int) -> DataFrame:
    """One row for each run of `rows` consecutive candidates of a partition, with its zone map."""

    def pack(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        number = 0

        def block(table: pa.Table):
            nonlocal number
            x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int32)
            column = lambda v, t: pa.array([v], t)
            out = pa.record_batch(
                [column((task << 32) | number, pa.int64()), column(x.min(0).tolist(), pa.list_(pa.int32())),
                 column(x.max(0).tolist(), pa.list_(pa.int32())), column(table["id"].to_pylist(), pa.list_(pa.int64())),
                 column(table["label"].to_pylist(), pa.list_(pa.int64())),
                 column(table["anchor"].to_pylist(), pa.list_(pa.bool_())), column(x.tobytes(), pa.binary())],
                ["block", "low", "high", "ids", "labels", "anchors", "vectors"])
            number += 1
            return out

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, rows))
                held = table.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    schema = ("block bigint, low array<int>, high array<int>, ids array<bigint>, labels array<bigint>, "
              "anchors array<boolean>, vectors binary")
    return candidates.select("id", "label", "anchor", "x").mapInArrow(pack, schema)


def tiles_of(blocks: DataFrame, width: int, positives: int) -> DataFrame:
    """The anchors of each block, `TILE` at most together, and for each the score of its last positive
    inside the block (null if the block has too few), which all its positives reach."""

    def cut(batches):
        for batch in batches:
            for block, ids, labels, marks, vectors in zip(*(batch[c] for c in ("block", "ids", "labels", "anchors", "vectors")), strict=True):
                x = matrix(vectors.as_buffer(), width)
                ids = ids.values.to_numpy()
                labels = labels.values.to_numpy()
                places = np.flatnonzero(marks.values.to_numpy(zero_copy_only=False))
                for start in range(0, len(places), TILE):
                    at = places[start:start + TILE]
                    scores = inner(x[at], x)
                    same = labels[at][:, None] == labels[None]
                    same[np.arange(len(at)), at] = False
                    reach = []
                    for r in range(len(at)):
                        s = scores[r, same[r]]
                        reach.append(int(np.partition(s, len(s) - positives)[len(s) - positives]) if len(s) >= positives else None)
                    # An anchor's number is its block's and its place in it.
                    yield pa.record_batch(
                        [pa.array([start // TILE], pa.int32()), pa.array([block.as_py()], pa.int64()),
                         pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([ids[at].tolist()], pa.list_(pa.int64())),
                         pa.array([labels[at].tolist()], pa.list_(pa.int64())), pa.array([reach], pa.list_(pa.int64())),
                         pa.array([x[at].astype(np.int32).tobytes()], pa.binary())],
                        ["tile", "home", "places", "anchor_ids", "anchor_labels", "reach", "anchor_vectors"])

    return blocks.select("block", "ids", "labels", "anchors", "vectors").mapInArrow(
        cut, "tile int, home bigint, places array<int>, anchor_ids array<bigint>, anchor_labels array<bigint>, "
             "reach array<bigint>, anchor_vectors binary")


def chosen(tiles: DataFrame, blocks: DataFrame, groups: int, width: int, kept) -> DataFrame:
    """Each tile beside each block that may hold what one of its anchors looks for.

    Zone maps are dealt to `groups` rows of some `ZONES`, and each tile goes to each such row.
    `kept(tile, least, most)` tells for anchors and zones whether the bounds allow anything.
    """
    zones = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")).agg(
        F.collect_list(F.struct("block", "low", "high")).alias("zones"))
    many = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = tiles.columns

    def pick(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                zone = batch["zones"][k].values
                at = zone.field("block").to_numpy()
                low, high = (zone.field(c).flatten().to_numpy().reshape(-1, width).astype(np.int64) for c in ("low", "high"))
                one = batch.slice(k, 1)
                least, most = bounds(matrix(one["anchor_vectors"][0].as_buffer(), width), low, high)
                meets = np.flatnonzero(kept(one, least, most).any(0))
                if len(meets):
                    again = pa.array(np.zeros(len(meets), np.int32))
                    yield pa.record_batch([*(one[c].take(again) for c in columns), pa.array(at[meets])], [*columns, "block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema.fields) + ", block bigint"
    return many.join(zones, "group").select(*columns, "zones").mapInArrow(pick, schema)


def numbers(values, missing: int) -> np.ndarray:
    """A list of longs as an array, nulls replaced."""
    return values.values.fill_null(missing).to_numpy()


def found_positives(met: DataFrame, width: int, positives: int) -> DataFrame:
    """The best scores of the anchors' own labels, from the pairs of tiles and blocks."""

    def look(batches):
        kept = Best(positives)
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch[c][k]  # noqa: E731, B023
                home, ids = get("home").as_py(), get("ids").values.to_numpy()
                scores = inner(matrix(get("anchor_vectors").as_buffer(), width), matrix(get("vectors").as_buffer(), width))
                allowed = (get("anchor_labels").values.to_numpy()[:, None] == get("labels").values.to_numpy()[None]) & (
                    scores >= numbers(get("reach"), NO_SCORE)[:, None])
                if home == get("block").as_py():
                    allowed[np.arange(len(allowed)), get("places").values.to_numpy()] = False
                order = np.argsort(ids, kind="stable")
                top, at = best(scores[:, order], allowed[:, order], positives)
                yield from kept.add(home, get("tile").as_py(), 0, top, ids[order][at % len(ids)])
        yield from kept.given()

    return met.mapInArrow(look, FOUND)


def found_negatives(met: DataFrame, width: int, negatives: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """The best scores of other labels inside each window, from the pairs of tiles and blocks."""

    def look(batches):
        kept = Best(negatives)
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch[c][k]  # noqa: E731, B023
                ids = get("ids").values.to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], get("labels").values.to_numpy()[order]
                scores = inner(matrix(get("anchor_vectors").as_buffer(), width), matrix(get("vectors").as_buffer(), width)[order])
                other = get("anchor_labels").values.to_numpy()[:, None] != labels[None]
                opened = get("scores").values.flatten().to_numpy().reshape(len(other), -1)
                for place in range(opened.shape[1]):
                    least, most = window(opened[:, place], low, high)
                    top, at = best(scores, other & (scores >= least[:, None]) & (scores <= most[:, None]), negatives)
                    yield from kept.add(get("home").as_py(), get("tile").as_py(), place + 1, top, ids[at % len(ids)])
        yield from kept.given()

    return met.mapInArrow(look, FOUND)


def window(score: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most score s with low * score <= s <= high * score; fractions as (over, under)."""
    there = score != NO_SCORE
    s = np.where(there, score, 0)
    least = -((-s * low[0]) // low[1])
    most = (s * high[0]) // high[1]
    return np.where(there, least, 1), np.where(there, most, 0)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of its label, the first `negatives` rows of
    other labels whose score lies between `low` and `high` (fractions) of the positive's.

    A score is the inner product of vectors of floor(scale * entry); higher scores come first, ties by
    smaller id, null ids last. `anchors` is a condition on the columns. Columns returned: anchor_id,
    positive_id, positive_rank, rank, negative_id, positive_score, negative_score (all longs but the ranks).
    Rows with a null label, a null vector, or an entry that is null or not finite take no part. A vector
    shorter than the longest counts as followed by zeros; an entry beyond 2^24 after scaling counts as that
    far. Rows of one id are rows of their own, each an anchor if the condition holds; equal rows give equal
    results. Other columns, whatever their names, are not read. An empty table, or none that is an anchor,
    gives no rows.
    """
    spark = vectors.sparkSession
    schema = ("anchor_id bigint, positive_id bigint, positive_rank int, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")
    plain = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(embedding).alias("e"), F.col(label).cast("bigint").alias("label"),
                           F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = finite_vectors(plain.where("label IS NOT NULL"), "e")
    width, many = kept.agg(F.max(F.size("e")), F.count("*")).first()
    if not many:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    x = whole_numbers("e", scale, 0, width, FAR).cast("array<int>")
    kept = staged(kept.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "anchor", x.alias("x")))
    places = kept.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(
        F.avg("v").alias("middle"), F.stddev_pop("v").alias("spread"))
    stats = sorted((r.place, r.middle, r.spread) for r in places.collect())  # one row a dimension
    middle, spread = np.array([s[1] for s in stats]), np.array([s[2] for s in stats])
    wide = np.argsort(-spread, kind="stable")
    cuts = middle[wide, None] + spread[wide, None] * np.array([-0.6745, 0.0, 0.6745])

    def keyed(batches):
        for batch in batches:
            v = batch["x"].flatten().to_numpy().reshape(-1, width)[:, wide]
            keys = hilbert_keys((v[:, :, None] > cuts[None]).sum(2), 2) if len(v) else np.zeros((0, 1), np.uint8)
            yield pa.record_batch([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*batch.schema.names, "key"])

    rows = min(LARGE, max(SMALL, many // WANTED))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), many // rows))
    # Blocks of a partition are cut by rows; the id keeps the copies of a vector from one partition.
    ordered = kept.mapInArrow(keyed, "id bigint, label bigint, anchor boolean, x array<int>, key binary")
    ordered = ordered.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").coalesce(parts)
    blocks = staged(packed_blocks(ordered, width, rows))
    groups = max(1, math.ceil(blocks.count() / ZONES))
    tiles = staged(tiles_of(blocks, width, positives))
    zones = blocks.select("block", "low", "high")
    bodies = blocks.select("block", "ids", "labels", "vectors")

    reaches = lambda tile, least, most: most >= numbers(tile["reach"][0], NO_SCORE)[:, None]
    met = chosen(tiles, zones, groups, width, reaches).join(bodies, "block")
    first = Window.partitionBy("home", "tile", "anchor").orderBy(F.desc("score"), "found")
    ranked = found_positives(met, width, positives).withColumn("place", F.row_number().over(first))
    ranked = staged(ranked.where(F.col("place") <= positives).withColumnsRenamed({"found": "positive"}))

    # The scores of an anchor's positives, in order, with NO_SCORE where there is none.
    filled = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda p: F.coalesce(F.try_element_at("by_place", p), F.lit(NO_SCORE)))
    opened = ranked.groupBy("home", "tile", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("by_place"))
    # At most `positives` scores an anchor, and TILE anchors a tile.
    gathered = opened.select("home", "tile", "anchor", filled.alias("s")).groupBy("home", "tile").agg(
        F.map_from_entries(F.collect_list(F.struct("anchor", "s"))).alias("by_anchor"))
    none = F.array_repeat(F.lit(NO_SCORE).cast("bigint"), positives)
    scores = F.transform(F.sequence(F.lit(0), F.size("places") - 1), lambda a: F.coalesce(F.try_element_at("by_anchor", a), none))
    windows = tiles.join(gathered, ["home", "tile"]).select(
        "home", "tile", "places", "anchor_labels", "anchor_vectors", scores.alias("scores"))

    def crosses(tile, least, most):
        scores = tile["scores"][0].values.flatten().to_numpy().reshape(len(least), -1)
        hit = np.zeros(least.shape, bool)
        for place in range(scores.shape[1]):
            start, stop = window(scores[:, place], low, high)
            hit |= (most >= start[:, None]) & (least <= stop[:, None]) & (start <= stop)[:, None]
        return hit

    met = chosen(windows, zones, groups, width, crosses).join(bodies, "block")
    first = Window.partitionBy("home", "tile", "anchor", "place").orderBy(F.desc("score"), "found")
    mined = found_negatives(met, width, negatives, low, high).withColumn("rank", F.row_number().over(first))
    mined = mined.where(F.col("rank") <= negatives).withColumnsRenamed({"score": "negative_score", "found": "negative"})
    names = tiles.select("home", "tile", F.posexplode("anchor_ids").alias("anchor", "anchor_id"))
    id_or_null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        mined.join(ranked.withColumnRenamed("score", "positive_score"), ["home", "tile", "anchor", "place"])
        .join(names, ["home", "tile", "anchor"])
        .select(id_or_null("anchor_id").alias("anchor_id"), id_or_null("positive").alias("positive_id"),
                F.col("place").alias("positive_rank"), "rank", id_or_null("negative").alias("negative_id"),
                "positive_score", "negative_score")
    )
