"""Whitening of embeddings: covariance over distinct vectors with weights, principal components, join back.

Entries become whole numbers, equal vectors are grouped with their counts, and each distinct vector is a
row of the fit with the weight one (or its count). Sums and deviations are exact; the covariance is a sum of
products of centred blocks, one matrix a task, added up in Spark. The driver gets sums and products alone,
whose number is the square of the vectors' width. Each distinct vector is whitened once and joined back to
its rows; the few vectors that many rows share (at most `HEAVY`, by their counts) are broadcast, so that no
key of the shuffled join holds more than one row in `HEAVY`.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A vector that more than one in so many rows share is heavy; there are fewer of them than this.
HEAVY = 1_000
#: Most rows of a block that a task multiplies at once.
BLOCK = 4_096
#: Entries beyond count as this far: 2^40 sixty-fourths, or what the scale makes of it.
FAR = 1 << 40
#: Directions whose variance is below this share of the largest are rounding, not components.
FLAT = 1e-10


def finite_vectors(rows: DataFrame, embedding: str) -> DataFrame:
    """The rows whose vector and all entries are there and finite."""
    there = F.forall(embedding, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    return rows.where(F.col(embedding).isNotNull() & there)


def whole_numbers(embedding: str, scale: int, shift: int, width: int, far: int):
    """floor(scale * entry) + shift, with entries of zero behind a shorter vector, as longs."""
    near = lambda e: F.least(F.greatest(F.floor(e.cast("double") * scale), F.lit(-far)), F.lit(far))
    far_off = lambda e: F.abs(e.cast("double")) > far  # noqa: E731  (`floor` to a long would overflow)
    entry = lambda e: F.when(far_off(e), F.signum(e.cast("double")).cast("bigint") * far).otherwise(near(e)) + F.lit(shift)
    padding = F.array_repeat(F.lit(shift).cast("bigint"), F.lit(width) - F.size(embedding))
    return F.concat(F.transform(embedding, entry), padding).cast("array<bigint>")


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches of `BLOCK` rows at most, with the matrix of their vectors `x`."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            yield piece, piece["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The total weight and the weighted sums of the dimensions."""

    def partial(batches):
        total, sums = 0, [0] * width
        for piece, x in blocks(batches, width):
            w = piece["weight"].to_numpy()
            safe = int(np.abs(x).max()) * int(w.sum()) < 2**62
            total += int(w.sum())
            part = (x * w[:, None]).sum(0) if safe else (x.astype(object) * w[:, None].astype(object)).sum(0)
            sums = [a + int(b) for a, b in zip(sums, part, strict=True)]
        if total:
            values = [Decimal(total), *map(Decimal, sums)]
            yield pa.record_batch([pa.array(range(width + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["place", "value"])

    added = fit.mapInArrow(partial, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
    found = {r.place: int(r.value) for r in added.collect()}
    return found.get(0, 0), [found.get(k + 1, 0) for k in range(width)]


def products(table: DataFrame, width: int, centred) -> np.ndarray:
    """The weighted sum over all rows of products of their centred vectors.

    `centred(piece)` gives the matrix of a piece and its weights.
    """

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                y, w = centred(batch.slice(start, BLOCK))
                total += y.T @ (y * w[:, None])
        places = np.indices((width, width), dtype=np.int32).reshape(2, -1)
        yield pa.record_batch([pa.array(places[0]), pa.array(places[1]), pa.array(total.ravel())], ["i", "j", "value"])

    added = table.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for batch in added.toArrow().to_batches():
        out[batch["i"].to_numpy(), batch["j"].to_numpy()] = batch["value"].to_numpy()
    return (out + out.T) / 2


def scaled_distance(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs, or Python's whole numbers where longs are too small."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared_lengths(d: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row."""
    top = int(np.abs(d).max(initial=0))
    if d.dtype != object and top * top * max(1, d.shape[1]) < 2**63:
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    whole = [int(v) for v in (d.astype(object) ** 2).sum(1)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0))


def whiten(rows: DataFrame, embedding: str = "embedding", scale: int = 64, shift: int = 1_000_000,
           components: int = 16, weights: str = "one", columns: list[str] | None = None) -> DataFrame:
    """Whitened vectors of all rows: columns `row` (a struct of `columns`, all by default), `n` (total weight),
    `deviation` (decimal, the exact sum over dimensions of (n x - S)^2), `whitened` and `explained` (arrays
    over the components, by falling variance) and `identity_error` (the largest absolute entry of the
    whitened covariance minus the identity).

    `weights="one"` fits each distinct vector once, `"count"` as often as it occurs. Rows whose vector is
    null, or holds a null or an entry that is not finite, are left out. A vector shorter than the longest
    counts as followed by zeros; entries beyond 2^40 (before scaling) count as that far. Components of at
    most 1e-10 of the largest variance are rounding and left out, so equal vectors alone give empty arrays;
    an empty table gives no rows. A deviation of 10^38 or more is null. Other columns may have any names
    and values, as they stay inside `row`; repeated rows are whitened alike.
    """
    spark = rows.sparkSession
    kept = finite_vectors(rows, embedding)
    width, many = kept.agg(F.max(F.size(embedding)), F.count("*")).first()
    width = max(1, width or 0)
    x = whole_numbers(embedding, scale, shift, width, FAR)
    named = kept.select(F.struct(*(columns or rows.columns)).alias("row"), x.alias("x"))
    counted = staged(named.groupBy("x").agg(F.count("*").alias("count")))
    fit = counted.withColumn("weight", F.lit(1).cast("bigint") if weights == "one" else F.col("count"))
    n, sums = exact_sums(fit, width)

    def centred(piece):
        d = scaled_distance(piece["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width), n, sums)
        return d.astype(float) / n, piece["weight"].to_numpy().astype(float)

    if n:
        covariance = products(fit, width, centred) / n
        variances, vectors = np.linalg.eigh(covariance)
        order = np.argsort(variances)[::-1][:components]
        order = [k for k in order if variances[k] > FLAT * variances[order[0]] and variances[k] > 0]
        project = vectors[:, order] / np.sqrt(variances[order])
        explained = (variances[order] / np.trace(covariance)).tolist()
    else:
        project, explained = np.zeros((width, 0)), []
    kinds = len(explained)

    def whitened(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                y, _ = centred(piece)
                d = scaled_distance(piece["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width), n, sums)
                z = np.ascontiguousarray(y @ project)
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * kinds)
                yield pa.record_batch([piece["x"], piece["weight"], piece["count"], squared_lengths(d),
                                       pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))],
                                      ["x", "weight", "count", "deviation", "whitened"])

    schema = "x array<bigint>, weight bigint, count bigint, deviation decimal(38,0), whitened array<double>"
    done = staged(fit.mapInArrow(whitened, schema)) if n else spark.createDataFrame([], schema)

    def as_they_are(piece):
        z = piece["whitened"].flatten().to_numpy(zero_copy_only=False).reshape(-1, kinds)
        return np.hstack([z, np.ones((len(z), 1))]), piece["weight"].to_numpy().astype(float)

    error = 0.0
    if kinds:  # the last row and column hold the sums, so the mean, nearly zero, is taken off exactly
        both = products(done, kinds + 1, as_they_are) / n
        error = float(np.abs(both[:-1, :-1] - np.outer(both[-1, :-1], both[-1, :-1]) - np.eye(kinds)).max())

    heavy = F.col("count") * HEAVY > F.lit(many)  # fewer than HEAVY, as the counts sum up to `many`
    facts = done.select("x", "deviation", "whitened", heavy.alias("_heavy"))
    few = F.broadcast(facts.where("_heavy"))
    shared = named.join(few, "x")
    others = named.join(few.select("x"), "x", "left_anti").join(facts.where("NOT _heavy"), "x")
    return shared.unionByName(others).select(
        "row", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
