"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed over whole texts by vectorised numpy in the tasks. Boosting runs on the
binned statistics of a bounded sample of labelled documents; the trees are flattened into arrays
that tasks walk for all documents of a batch at once.

Nulls and empty texts have the statistics of the empty text and get a score like any other.
Labels other than 0 and 1, null labels and rows whose id has no document are not learned from. If
no label remains, every score is 0.5; if all agree, the score is that label's smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import owners, raw_bytes, slices, utf8, white_words

#: At most about so many labelled documents are learned from, chosen by a hash of their id.
SAMPLE = 20_000

# Byte classes that are counted, by their characters.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f",
           ".", ",", "!?", ":;'\"()-", "#$%&*@^~+=_<>\\/", "|", "{}[]`")
OTHER, TAIL = len(CLASSES), len(CLASSES) + 1
TABLE = np.full(256, OTHER, np.uint8)
TABLE[:128] = OTHER
TABLE[128:192] = TAIL  # later bytes of a character of several bytes
for _k, _chars in enumerate(CLASSES):
    TABLE[list(_chars.encode())] = _k

#: Statistics of a document, in the order of the columns of `statistics`.
NAMES = (*(f"share_{k}" for k in range(len(CLASSES) + 1)), "log_chars", "log_words", "word_length",
         "distinct_words", "top_word", "log_lines", "line_length", "repeated_lines", "unfinished_lines",
         "symbol_words", "capital_words")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text of an array made by `utf8`."""
    n = len(texts)
    data, offsets = raw_bytes(texts)
    sizes = np.diff(offsets)
    width = TAIL + 1
    counts = np.bincount(owners(sizes) * width + TABLE[data], minlength=n * width).reshape(n, width).astype(float)
    chars = np.maximum(sizes - counts[:, TAIL], 0)
    some = np.maximum(chars, 1)
    words, per = white_words(texts)
    many = np.maximum(per, 1)
    doc = owners(per)
    codes = pc.dictionary_encode(words)
    kinds = max(1, len(codes.dictionary))
    pairs, repeats = np.unique(doc * kinds + codes.indices.to_numpy(), return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, pairs // kinds, repeats)
    distinct = np.bincount(pairs // kinds, minlength=n)
    symbol = pc.match_substring_regex(codes.dictionary, r"[#$%&*!|]").to_numpy(zero_copy_only=False)
    capital = pc.match_substring_regex(codes.dictionary, r"^[^a-z]*[A-Z]{2}[^a-z]*$").to_numpy(zero_copy_only=False)
    at = codes.indices.to_numpy()
    share = lambda flags: np.bincount(doc, weights=flags[at].astype(float), minlength=n) / many
    lines = [t.split("\n") for t in texts.to_pylist()]
    rows = np.array([[len(x), len(set(x)), sum(s[-1:] not in ".!?\"" or not s for s in x)] for x in lines],
                    float).reshape(n, 3)
    return np.column_stack([
        counts[:, :TAIL] / some[:, None], np.log1p(chars), np.log1p(per), (chars - counts[:, 3]) / many,
        distinct / many, top / many, np.log(rows[:, 0]), chars / rows[:, 0], 1 - rows[:, 1] / rows[:, 0],
        rows[:, 2] / rows[:, 0], share(symbol), share(capital)])


@dataclass
class Trees:
    """Complete binary trees in arrays: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; a value up to the limit goes left
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        depth, rows = (self.leaf.shape[1] - 1).bit_length(), np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
          least: int = 10, smooth: float = 1.0) -> Trees:
    """Boosted trees for the log-loss; splits are searched in histograms of gradients over bins."""
    y = np.asarray(y, float)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(out.feature[:0], out.limit[:0], out.leaf[:0].reshape(0, leaves), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    wide = x.shape[1] * bins
    cell = binned + np.arange(x.shape[1]) * bins
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            key = ((node - first)[:, None] * wide + cell).ravel()
            sums = [np.bincount(key, np.repeat(v, x.shape[1]), size * wide).reshape(size, x.shape[1], bins)
                    .cumsum(2) for v in (g, h, np.ones(len(y)))]
            left, right = [s[:, :, :-1] for s in sums], [s[:, :, -1:] - s[:, :, :-1] for s in sums]
            whole = [s[:, :, -1:] for s in sums]
            gain = (left[0]**2 / (left[1] + smooth) + right[0]**2 / (right[1] + smooth)
                    - whole[0]**2 / (whole[1] + smooth))
            gain[(left[2] < least) | (right[2] < least)] = -1
            best = gain.reshape(size, -1).argmax(1)
            for k in range(size):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    out.feature[t, first + k], out.limit[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.limit[t, node])
        node -= inner
        leaf = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + smooth)
        out.leaf[t] = leaf
        total += leaf[node]
    return out


def train_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees learned from the labelled documents.

    Of more than `sample` labels, those are taken whose hashed id is below a threshold that lets
    about `sample` through; their ids are broadcast, and only their statistics reach the driver.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = documents.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "key")

    def measured(batches):
        for batch in slices(batches):
            x = statistics(utf8(batch["text"]))
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch["label"]], ["x", "label"])

    found = rows.select("text", "label").mapInArrow(measured, "x array<double>, label double").toArrow()
    if not found.num_rows:
        return boost(np.zeros((0, len(NAMES))), np.zeros(0))
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    y = found["label"].to_numpy()
    order = np.lexsort((y, *x.T))  # the same trees in whichever order the rows arrive
    return boost(x[order], y[order])


def score_quality(documents: DataFrame, model: Trees, text_col: str = "text",
                  columns: list[str] | None = None) -> DataFrame:
    """These columns of the table, all by default, with `quality_score` from 0 to 1 in place of any of that name."""
    kept = [F.col(f"`{c}`") for c in columns or documents.columns if c != "quality_score"]
    rows = documents.select(F.struct(*kept).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("row").schema.add("score", "double")

    def scored(batches):
        for batch in slices(batches):
            yield pa.record_batch([batch["row"], pa.array(model.score(statistics(utf8(batch["text"]))))],
                                  ["row", "score"])

    return rows.mapInArrow(scored, schema).select("row.*", F.col("score").alias("quality_score"))
