"""Shards: equal counts, the mixture in each, and files."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tableprobe.llm.sharding import interleave, write_shards


def by_hand(rows, shards, seed=11):
    """Places and shards of (id, source) pairs, ids being distinct."""
    import hashlib

    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    groups = defaultdict(list)
    for key, source in rows:
        groups["n" if source is None else f"s{source}"].append((digest(f"{seed}:{key}"), key))
    placed = []
    for name, members in groups.items():
        phase = int(digest(f"{seed}:{name}")[:8], 16) / 2**32
        placed += [((k + phase) / len(members), name, k, key) for k, (_, key) in enumerate(sorted(members))]
    out, slots = {}, Counter()
    for at, (*_, key) in enumerate(sorted(placed)):
        shard = at * shards // len(placed)
        out[key] = (shard, slots[shard])
        slots[shard] += 1
    return out


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_brute_force(spark, shards):
    rows = [(k, None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 5}") for k in range(997)] + [(5000 + k, f"only{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    found = {r.doc_id: (r.shard, r.slot) for r in interleave(df.repartition(5), shards).select("row.doc_id", "shard", "slot").collect()}
    assert found == by_hand(rows, shards)


def test_mixture_and_counts(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("source"))
    found = interleave(df, 16).select("row.source", "shard").groupBy("shard", "source").count().collect()
    total, shard = Counter(), Counter()
    for r in found:
        total[r.source] += r["count"]
        shard[r.shard] += r["count"]
    assert max(shard.values()) - min(shard.values()) <= 1 and len(shard) == 16
    assert all(abs(r["count"] - total[r.source] / 16) <= 2 for r in found)


def test_awkward(spark, awkward, empty):
    assert interleave(empty, 4).count() == 0
    keys = ("doc_id", "text")
    placed = interleave(awkward, 4, keys=keys)
    assert placed.columns == ["row", "place", "shard", "slot"]
    found = placed.collect()
    assert Counter(repr(r.row) for r in found) == Counter(repr(r) for r in awkward.collect())
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = interleave(awkward.repartition(1), 4, keys=keys).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))  # the order does not depend on partitions
    none = awkward.withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    assert interleave(none, 100).groupBy("shard").count().where("count > 1").count() == 0  # more shards than rows


def test_files(spark, awkward, tmp_path):
    placed = interleave(awkward, 3, keys=("doc_id", "text"))
    write_shards(placed, str(tmp_path / "out"), rows_per_file=5)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, read.select("row", "shard", "slot").collect())) == sorted(map(repr, placed.select("row", "shard", "slot").collect()))
    files = read.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert all(r.n <= 5 and r.b - r.a == r.n - 1 for r in files)
