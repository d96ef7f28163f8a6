"""Shards of equal counts that each hold the mixture of sources: proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; rank k (from 0) of a source of n rows
stands at (k + phase) / n, where the source's phase comes from its name. All rows in the order of these
places are cut into runs whose lengths differ by one at most. Any run of that order holds of each source
its share, to within one row, and so does each shard.

No window is over a whole source or table. Ranks are counted in cells that hold about sqrt(rows) rows, of
hash values first and of places then, behind running totals of the cells, of which there are about
sqrt(rows) too. A source of a third of all rows is spread over all cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Values of the first eight hexadecimal digits of a digest.
DRAWS = 1 << 32


def draw(digest: Column) -> Column:
    """A whole number below 2^32 from a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def totals_before(cells: DataFrame, order: str, *by: str) -> DataFrame:
    """The cells with the total of `count` in the cells before and in all."""
    over = Window.partitionBy(*by)
    before = over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("*", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"),
                        F.sum("count").over(over).alias("_size"))


def interleave(rows: DataFrame, shards: int, stratum: str = "source",
               keys: tuple[str, ...] = ("doc_id",), seed: int = 11) -> DataFrame:
    """Columns `row` (a struct of the columns given), `place` (double, 0 to 1), `shard` (0 to shards - 1)
    and `slot` (from 0 in each shard, without gaps, in the mixed order).

    All columns given travel through two shuffles, so give only those that are needed. The order depends on
    the values alone, not on partitions. Rows of equal keys fall into one cell, ordered by a hash of all their
    columns, so `keys` should tell rows apart; rows that are equal throughout are interchangeable. A null
    stratum is a stratum of its own, a null key is like an empty one. Texts of any length are only carried.
    An empty table gives no rows; with fewer rows than shards some shards have none. Columns may have any
    names, as they stay inside `row`; maps can't be among them.
    """
    many = rows.count()
    cells = max(1, math.isqrt(many))
    name = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    drawn = rows.select(F.struct("*").alias("row"), name.alias("_stratum"), digest.alias("_draw"),
                        F.xxhash64("*").alias("_tie"))
    drawn = drawn.withColumn("_cell", F.shiftright(draw(F.col("_draw")) * cells, 32))
    counted = totals_before(drawn.groupBy("_stratum", "_cell").count(), "_cell", "_stratum")
    in_cell = Window.partitionBy("_stratum", "_cell").orderBy("_draw", "_tie")
    phase = draw(F.md5(F.concat(F.lit(f"{seed}:"), "_stratum").cast("binary"))) / F.lit(float(DRAWS))
    placed = (
        drawn.join(counted, ["_stratum", "_cell"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_cell) - 1)
        .withColumn("place", (F.col("_rank") + phase) / F.col("_size"))
        .select("row", "_stratum", "_rank", "place", F.floor(F.col("place") * cells).alias("_cell"))
    )
    placed = staged(placed)
    counted = totals_before(placed.groupBy("_cell").count(), "_cell").select("_cell", "_before")
    in_cell = Window.partitionBy("_cell").orderBy("place", "_stratum", "_rank")
    at = F.col("_before") + F.row_number().over(in_cell) - 1
    shard = F.expr(f"_at * {shards} div {max(1, many)}")
    first = F.expr(f"(shard * {many} + {shards - 1}) div {shards}")
    return (
        placed.join(counted, "_cell").withColumn("_at", at).withColumn("shard", shard)
        .select("row", "place", F.col("shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot"))
    )


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write what `interleave` gave as Parquet, a folder `shard=N` for each shard.

    A file holds a run of at most `rows_per_file` slots (more only where the hash of two runs is one task,
    which writes them one after the other), sorted by slot. No rows write no shard.
    """
    part = F.expr(f"slot div {rows_per_file}")
    (placed.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))
