"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became lower case. A window is `size`
consecutive words of an item; an item of fewer words, but not none, is one window. Training texts
are scanned by the hashes of their own windows; a hit is verified by its words. Everything is
DataFrame work.

The set is broadcast up to `BROADCAST_WINDOWS` distinct windows, counted first; a larger one is
joined by shuffling the window hashes. Null and empty texts have no words and no hits. Repeated
rows are judged one by one; benchmark rows of one id are one item, and those without an id count
for hits but have no id to list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged

#: Words of a window.
SIZE = 13
#: So many words at the start of a window are the key by which it is looked up; then all are compared.
KEY = 3
#: At most so many distinct windows (about 200 bytes each) are broadcast.
BROADCAST_WINDOWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP), lambda w: w != "")


def _each(words: Column, width: int, make) -> Column:
    """`make` of (start, the words from there) for each window of this width. The words are taken
    one by one, as `slice` inside a lambda walks the whole array."""
    last = F.size(words) - width
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                       lambda i: make(i, [F.get(words, i + k) for k in range(width)]))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct windows: `gram`, its number of words `width`, its `hash`, and the ids of its `items`, sorted."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("words"))
    grams = words.where(F.size("words") > 0).select(
        "item", F.least(F.size("words"), F.lit(size)).alias("width"),
        F.explode(F.when(F.size("words") < size, F.array(F.array_join("words", " "))).otherwise(
            _each(F.col("words"), size, lambda _, w: F.concat_ws(" ", *w)))).alias("gram"))
    return grams.groupBy("gram", "width").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn(
        "hash", F.xxhash64("gram"))


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, text_col: str = "text",
                   item_col: str = "item_id", columns: list[str] | None = None,
                   limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row of the table: `row` with these columns (all by default), `n_words`,
    `hits`: the distinct occurrences (at, width), in words from 0, in order, `items`: the sorted
    distinct ids of the items whose windows occur, and `n_hit`: the words inside any occurrence.

    One scan reads each text once; of a text only its hits and one summary row leave the scan.
    """
    known = staged(benchmark_windows(benchmark, size, item_col))
    small = known.count() <= limit
    lengths = sorted({min(KEY, r[0]) for r in known.select("width").distinct().collect()})  # 1 to KEY
    mark = known.sparkSession.createDataFrame(
        [(0, None, 0, None)], "code bigint, gram string, width int, items array<string>")
    words = F.split("gram", " ")
    against = known.select(F.xxhash64(*[F.get(words, F.lit(k)) for k in range(KEY)]).alias("code"), "gram", "width",
                           "items").unionByName(mark)
    rows = documents.select(
        F.monotonically_increasing_id().alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in columns or documents.columns]).alias("row"),
        plain_words(F.col(text_col)).alias("words"))
    # The first code is the mark of the text itself; after it come those of each key length in turn.
    codes = F.concat(F.array(F.lit(0).cast("bigint")), *[
        _each(F.col("words"), k, lambda _, w: F.xxhash64(*w)) for k in lengths])
    at = F.lit(None).cast("int")
    before = [F.lit(1)]
    for k in lengths:
        before.append(before[-1] + F.greatest(F.size("words") - k + 1, F.lit(0)))
    for start in before[:-1]:
        at = F.when(F.col("pos") >= start, F.col("pos") - start).otherwise(at)
    scanned = rows.select("key", "row", "words", F.posexplode(codes).alias("pos", "found"))
    width = F.greatest("width", F.lit(1))
    if small:  # the words of a window are looked at where its key is found
        own = F.slice("words", F.coalesce(at, F.lit(0)) + 1, width)
        against = F.broadcast(against)
    else:  # each key travels with the words of its window alone, the row with the mark alone
        start = F.col("pos") == 0
        scanned = scanned.select(
            "key", "pos", "found", at.alias("at"), F.when(start, F.col("row")).alias("row"),
            F.when(start, F.size("words")).alias("n_words"), F.slice("words", F.coalesce(at, F.lit(0)) + 1, F.lit(size)).alias("words"))
        own = F.slice("words", F.lit(1), width)
    joined = scanned.join(against, F.col("found") == F.col("code")).where(
        ((F.col("pos") == 0) & F.col("gram").isNull())
        | ((F.col("pos") > 0) & (F.array_join(own, " ") == F.col("gram"))))
    if small:
        joined = joined.withColumns({"at": at, "n_words": F.size("words")})
    real = F.col("pos") > 0
    whole = joined.groupBy("key").agg(
        F.first(F.when(~real, F.col("row")), ignorenulls=True).alias("row"),
        F.max(F.when(~real, F.col("n_words"))).alias("n_words"),
        F.sort_array(F.collect_set(F.when(real, F.struct("at", "width")))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, h: F.struct(
            (a.n + F.greatest(h.at + h.width - F.greatest(h.at, a.stop), F.lit(0))).alias("n"),
            F.greatest(a.stop, h.at + h.width).alias("stop")),
        lambda a: a.n)
    return whole.select("row", "n_words", covered.alias("n_hit"), "hits", "items")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Some word is hit, and at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, text_col: str = "text",
                  remove: str = "documents", item_col: str = "item_id") -> DataFrame:
    """The table without its contaminated documents, or (`remove="spans"`) with the words of all
    occurrences cut out of the texts."""
    if remove == "spans":
        found = benchmark_hits(documents, benchmark, size, text_col, item_col)
        # The same words as `plain_words` finds, in the unchanged text.
        word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        text = F.col(f"row.{text_col}")
        hit = F.flatten(F.transform("hits", lambda h: F.sequence(h.at, h.at + h.width - 1)))
        gaps, words = F.split(text, word), F.regexp_extract_all(text, F.lit(word), F.lit(0))
        gone = F.map_from_entries(F.transform(F.array_distinct(hit), lambda p: F.struct(p, F.lit(True))))
        cut = F.array_join(F.transform(gaps, lambda g, i: F.concat(
            g, F.when(F.map_contains_key(gone, i), "").otherwise(F.coalesce(F.get(words, i), F.lit(""))))), "")
        new = F.when(F.size("hits") > 0, cut).otherwise(text)
        return found.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
    if remove != "documents":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    same = lambda t: F.sha2(F.coalesce(t.cast("string"), F.lit("")), 256)
    # Whether a document goes depends on its text alone, so the texts' digests say which go.
    bad = benchmark_hits(documents.select(F.col(text_col).alias("text")), benchmark, size, "text", item_col)
    bad = bad.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(
        same(F.col("row.text")).alias("gone")).distinct()
    return documents.join(bad, same(F.col(text_col)) == F.col("gone"), "left_anti")
