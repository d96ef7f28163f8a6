"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

A text is `▁` and its characters with spaces as `▁`. A lattice has an edge for each piece that
occurs, and, where a character is no piece, one for its UTF-8 bytes as byte pieces, at a penalty
below all scores. Forward Viterbi gives the best score up to each position; searched backward from
the end, these scores are the exact rest of every path, so A-star finds the N best in order.

No piece joins a `▁` to what stands before it, so a text is a chain of independent lattices, one for
each word. Its best path joins the words' best; of its N best, the others deviate only in the
`N - 1` words with the smallest loss, which Viterbi knows as the least margin on the best path; there
A-star lists the words' own N best, and their sums are merged. That is exact, not a beam.

The scores are those of the model file, taken as they stand. Pieces that the file marks as control,
unknown or unused have no edges. Null and empty texts have no pieces, score 0 and one path. Among
paths of one score the order is that of the search, the same in every run. A `▁` in the text itself
becomes bytes, so decoding gives every text back.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, utf8

SPACE = "▁"
#: Stands for a `▁` of the text itself; no text holds it, as it is half of a surrogate pair.
OWN = "\ud800"
LEAST = -float("inf")
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes of solved words, about, after which a Python worker forgets all and starts anew, and what a
#: word takes besides its characters.
REMEMBERED, HELD = 32 << 20, 240
#: Bytes of text whose new words are solved together.
TOGETHER = 1 << 20
#: Words up to this length are solved together.
SHORT = 48


@dataclass
class Vocabulary:
    """Pieces and scores; `table` maps each prefix of a piece to (score, id), or to None
    if it is no piece. Ids in it are little-endian 32-bit numbers."""

    table: dict
    single: list  # ids of the 256 byte pieces, in the same form
    spelled: list  # by id, the bytes that a piece stands for
    penalty: float
    unit: str  # pattern of the independent parts
    codes: np.ndarray  # sorted mixed codes of all prefixes of pieces
    starts: np.ndarray  # for each value of their top 20 bits, where these begin
    scores: np.ndarray  # by such a code, the piece's score, or NaN
    numbers: np.ndarray  # by such a code, the piece's id


def code(text: str) -> int:
    """A 64-bit code of a short text, extended character by character."""
    found = 0
    for c in text:
        found = (found * MULTIPLIER + ord(c) + 1) % 2**64
    return found


def mixed(codes: np.ndarray) -> np.ndarray:
    """Codes with their bits spread, one to one."""
    return (codes ^ (codes >> np.uint64(32))) * np.uint64(MULTIPLIER)


def rows_of(v: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Where these mixed codes stand in `v.codes`, if they do; few share their top bits."""
    row, last = v.starts[codes >> np.uint64(44)], len(v.codes) - 1
    later = np.flatnonzero((v.codes[row] < codes) & (row < last))
    while len(later):
        row[later] += 1
        later = later[(v.codes[row[later]] < codes[later]) & (row[later] < last)]
    return row


def number(k: int) -> bytes:
    return k.to_bytes(4, "little")


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table, single, spelled, low = {}, [b""] * 256, [b""] * model.get_piece_size(), 0.0
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            single[int(piece[3:-1], 16)] = number(k)
            spelled[k] = bytes([int(piece[3:-1], 16)])
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses words")
            table[piece] = (model.get_score(k), number(k))
            spelled[k] = piece.replace(SPACE, " ").encode()
            low = min(low, model.get_score(k))
    alone = "" if any("\n" in p and len(p) > 1 for p in table) else "\n"
    for piece in list(table):
        for stop in range(1, len(piece)):
            table.setdefault(piece[:stop], None)
    mark = f"{SPACE}{alone}"
    unit = f"{SPACE}*[^{mark}]+|{SPACE}+" + (f"|{alone}" if alone else "")
    prefixes = sorted(table)
    codes = mixed(np.array([code(p) for p in prefixes], np.uint64))
    order = np.argsort(codes)
    if len(np.unique(codes)) < len(codes):
        raise ValueError("two prefixes of pieces have one code")
    found = [table[p] or (float("nan"), b"\0\0\0\0") for p in prefixes]
    starts = np.searchsorted(codes[order], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
    starts = np.minimum(starts, len(codes) - 1).astype(np.int32)
    return Vocabulary(table, single, spelled, low - 10.0, unit, codes[order], starts, np.array([f[0] for f in found])[order],
                      np.frombuffer(b"".join([f[1] for f in found]), "<i4")[order])


def fallback(v: Vocabulary, character: str) -> bytes:
    return b"".join([v.single[b] for b in (SPACE if character == OWN else character).encode()])


def solve(v: Vocabulary, word: str) -> tuple[float, float, bytes]:
    """Score of the best path, loss of the second best path, and the ids of the best."""
    best, second, back = _forward(v, word, None)
    ids, loss, at = [], float("inf"), len(word)
    while at:
        loss = min(loss, best[at] - second[at])
        at, piece = back[at]
        ids.append(piece)
    ids.reverse()
    return best[-1], loss, b"".join(ids)


def _forward(v: Vocabulary, word: str, ends: list[list] | None) -> tuple[list, list, list]:
    """Best and second best score up to each position, and the best edge that ends there. Lists all
    edges (start, score, ids) by their end in `ends`, where given."""
    size, get = len(word), v.table.get
    best, second, back = [LEAST] * (size + 1), [LEAST] * (size + 1), [None] * (size + 1)
    best[0] = 0.0
    for start in range(size):
        base, stop = best[start], start + 1
        found = get(word[start:stop], 0)
        go_on = found != 0
        if not found:
            found = (v.penalty, fallback(v, word[start]))
        while True:
            if found:
                score = base + found[0]
                if score > best[stop]:
                    second[stop] = best[stop]
                    best[stop] = score
                    back[stop] = (start, found[1])
                elif score > second[stop]:
                    second[stop] = score
                if ends is not None:
                    ends[stop].append((start, *found))
            if not go_on or stop == size:
                break
            stop += 1
            found = get(word[start:stop], 0)
            if found == 0:
                break
    return best, second, back


def best_paths(v: Vocabulary, word: str, count: int) -> list[tuple[float, bytes]]:
    """The `count` best paths of a word, best first: backward A-star with the forward scores as the rest."""
    ends = [[] for _ in range(len(word) + 1)]
    best = _forward(v, word, ends)[0]
    heap, order, found = [(-best[-1], 0, len(word), 0.0, None)], 1, []
    while heap and len(found) < count:
        cost, _, at, done, path = heapq.heappop(heap)
        if not at:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            found.append((-cost, b"".join(ids)))
        for start, score, ids in ends[at]:
            heapq.heappush(heap, (-(best[start] + score + done), order, start, done + score, (ids, path)))
            order += 1
    return found


def units(v: Vocabulary, text: str) -> list[str]:
    """The independent parts of a text."""
    return re.findall(v.unit, SPACE + text.replace(SPACE, OWN).replace(" ", SPACE)) if text else []


def solve_many(v: Vocabulary, words: list[str]) -> list[tuple[float, float, bytes]]:
    """`solve` for many words, by numpy: all words advance together, start by start, length by length."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word, first = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    local = np.arange(len(chars)) - first[word]
    odd = np.zeros(len(words), bool)
    # Edges from each character on, by length.
    at, codes, edges = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
    for length in range(1, len(chars) + 1):
        codes = codes * np.uint64(MULTIPLIER) + chars[at + length - 1] + np.uint64(1)
        sought = mixed(codes)
        row = rows_of(v, sought)
        known = v.codes[row] == sought
        piece = known & ~np.isnan(v.scores[row])
        if length == 1:
            odd[word[at[~piece]]] = True
        edges.append((at[piece], np.full(piece.sum(), length), row[piece]))
        go_on = known & (local[at] + length < sizes[word[at]])
        at, codes = at[go_on], codes[go_on]
        if not len(at):
            break
    start, length, row = (np.concatenate(x) for x in zip(*edges, strict=True))
    # Slots: one before each character and one after the last.
    step = local[start] * (length.max(initial=0) + 1) + length
    if step.max(initial=0) < 1 << 16:  # sorted by radix
        step = step.astype(np.uint16)
    order = np.argsort(step, kind="stable")
    source = (start + word[start])[order]
    target, score, row = source + length[order], v.scores[row][order], row[order]
    total = len(chars) + len(words)
    best, second = np.full(total, LEAST), np.full(total, LEAST)
    back, by = np.zeros(total, np.int64), np.zeros(total, np.int64)
    zero = first + np.arange(len(words))
    best[zero] = 0.0
    step = step[order]
    cuts = np.concatenate([[0], np.flatnonzero(step[1:] != step[:-1]) + 1, [len(step)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        src, dst = source[a:b], target[a:b]
        new, old = best[src] + score[a:b], best[dst]
        better = new > old
        second[dst] = np.where(better, old, np.maximum(second[dst], new))
        best[dst] = np.where(better, new, old)
        back[dst[better]], by[dst[better]] = src[better], row[a:b][better]
    # The best paths, from the ends.
    loss, who, slot, taken = np.full(len(words), np.inf), np.flatnonzero(~odd), (zero + sizes)[~odd], []
    steps = np.zeros(len(words), np.int64)
    while len(who):
        loss[who] = np.minimum(loss[who], best[slot] - second[slot])
        taken.append((who, v.numbers[by[slot]]))
        steps[who] += 1
        slot = back[slot]
        more = slot > zero[who]
        who, slot = who[more], slot[more]
    ends = np.cumsum(steps)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, "<i4")
    for k, (who, ids) in enumerate(taken):
        flat[ends[who] - 1 - k] = ids
    spelled = flat.tobytes()
    score, starts, stops = best[zero + sizes].tolist(), ((ends - steps) * 4).tolist(), (ends * 4).tolist()
    return [solve(v, words[k]) if bad else (score[k], lost, spelled[starts[k]:stops[k]])
            for k, (bad, lost) in enumerate(zip(odd.tolist(), loss.tolist(), strict=True))]


class Solved(dict):
    """Solved words of a vocabulary, found when first asked for."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v
        self.bytes = 0
        self.listed = {}

    def __missing__(self, word: str):
        self[word] = found = solve(self.v, word)
        self.bytes += HELD + 6 * len(word)
        return found

    def paths(self, word: str, count: int) -> list[tuple[float, bytes]]:
        """`best_paths` of a word, remembered for words that are not long."""
        if len(word) > SHORT:
            return best_paths(self.v, word, count)
        found = self.listed.get((word, count))
        if found is None:
            found = self.listed[word, count] = best_paths(self.v, word, count)
            self.bytes += (count + 1) * (HELD + 6 * len(word))
        return found

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Solves the new words of these texts together, and forgets the old ones when there are too many.
        Returns the units of each text."""
        if self.bytes > REMEMBERED:
            self.clear()
            self.listed.clear()
            self.bytes = 0
        parts = [units(self.v, t) for t in texts]
        new = set().union(*parts).difference(self)
        short = [w for w in new if len(w) <= SHORT]
        self.update(zip(short, solve_many(self.v, short), strict=True))
        self.bytes += sum(HELD + 6 * len(w) for w in short)
        return parts


def segment(solved: Solved, words: list[str], count: int) -> tuple[list[bytes], list[float], list[tuple]]:
    """The ids of each unit's best path, the scores of the `count` best segmentations of a text of these units,
    best first, and what each changes: pairs of a unit's number and its ids. The first changes nothing."""
    found = list(map(solved.__getitem__, words))
    scores, losses, parts = zip(*found, strict=True) if found else ((), (), ())
    total = sum(scores)
    # (loss, changes) of the best combinations so far
    sums = [(0.0, ())]
    for _, k in heapq.nsmallest(count - 1, zip(losses, range(len(losses)), strict=True)):
        paths = solved.paths(words[k], count)
        more = [(loss + paths[0][0] - score, changes + ((k, ids),) if n else changes)
                for loss, changes in sums for n, (score, ids) in enumerate(paths)]
        sums = heapq.nsmallest(count, more, key=lambda x: x[0])
    return parts, [total - loss for loss, _ in sums], [changes for _, changes in sums]


def encode_all(solved: Solved, text: str, count: int) -> list[tuple[float, list[int]]]:
    """The `count` best segmentations in full."""
    parts, scores, changed = segment(solved, units(solved.v, text), count)
    return [(score, np.frombuffer(b"".join([dict(changes).get(k, p) for k, p in enumerate(parts)]), "<i4").tolist())
            for score, changes in zip(scores, changed, strict=True)]


def decode(v: Vocabulary, ids) -> str:
    """The text of these ids; the space that encoding put in front is taken off."""
    return b"".join(map(v.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


def segmented(documents: DataFrame, vocabulary: Vocabulary, nbest: int = 4, text_col: str = "text",
              columns: list[str] | None = None) -> DataFrame:
    """These columns of the table, all by default, with `piece_ids` of the best segmentation,
    `nbest_scores`, `ids_sha256` (of the ids as little-endian 32-bit numbers) and `restored`:
    whether decoding gives the text back. Columns of these names in the table are replaced."""
    new = {"piece_ids": T.ArrayType(T.IntegerType()), "nbest_scores": T.ArrayType(T.DoubleType()),
           "ids_sha256": T.StringType(), "restored": T.BooleanType()}
    own = list(new)
    names = [c for c in columns or documents.columns if c not in own]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                            F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(
        tuple(getattr(vocabulary, f.name) for f in fields(vocabulary)))

    def encoded(batches):
        v = Vocabulary(*shared.value)
        solved = Solved(v)
        for batch in slices(batches, limit=TOGETHER):
            ids, scores, digests, restored = [], [], [], []
            texts = utf8(batch["text"]).to_pylist()
            for text, words in zip(texts, solved.learn(texts), strict=True):
                parts, best, _ = segment(solved, words, nbest)
                found = b"".join(parts)
                scores.append(best)
                ids.append(np.frombuffer(found, "<i4"))
                digests.append(hashlib.sha256(found).hexdigest())
                restored.append(decode(v, ids[-1].tolist()) == text)
            yield pa.record_batch([batch["row"], pa.array(ids, pa.list_(pa.int32())),
                                   pa.array(scores, pa.list_(pa.float64())), pa.array(digests, pa.string()),
                                   pa.array(restored, pa.bool_())], ["row", *own])

    schema = rows.select("row").schema
    for c, kind in new.items():
        schema = schema.add(c, kind)
    return rows.mapInArrow(encoded, schema).select("row.*", *own)
