"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and the words around each hit.

Terms are learned from a bounded sample of labelled documents: whole words and stems (word
beginnings) that toxic documents hold more often than chance allows, whatever the number of words
tried, and in both halves of the sample, from which copies and near copies are left out, as these
would make all their words terms. A word of a text hits a term if it is the term, begins with
a stem, or lies within one edit of a term of `FUZZY` letters or more; the last are found by running
the word's Levenshtein automaton along the trie of the terms.

A hit has the weight of its term, times a factor between 0 and 1 if it is misspelled (one factor for words
of letters alone, which accident also brings near a term, and one for those disguised by other signs), times
the share that its context leaves: the words within `CONTEXT` on either side, and quotation marks that
enclose it, tell quotation from abuse by how often hits in clean and in toxic documents have them near; the
clearest sign of quotation counts. A logistic model of the strongest hit and of all hits together, neither of which can count against toxicity, gives
the score. Weights that a document helped to learn are not used when the model is fitted to it.

Null, empty and white-space texts have no hits and get the least score; long texts are read whole, in
one step if they are longer than a slice; repeated rows and ties get equal scores; an empty table gives no
rows. Labels other than 0 and 1 are not learned from, and two labels of one document count as two; without
any label of one kind every score is the smoothed share of ones, or 0.5. Columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import owners, slices, staged, utf8, white_words

#: At most about so many labelled documents are learned from, chosen by a hash of their id.
SAMPLE = 20_000
#: Letters of a stem, and least letters of a term that may be misspelled.
STEM = range(4, 9)
FUZZY = 5
#: Words on either side of a hit in which quotation marks are looked for.
CONTEXT = 12
#: Terms that chance alone would give, over all that are tried, and of context words.
BY_CHANCE = 0.5
#: Factor of a misspelled hit where the sample does not tell, and how many hits that is worth.
MISSPELLED, WORTH = 0.7, 4.0
#: Log odds from which a word near a hit is a sign of quotation.
QUOTING = -2.0
#: Words of a shingle; marks of a text, and how many of them earlier texts must have for it to be a near copy.
SHINGLE, COPY_MARKS, COPIED = 5, 16, 12
#: Stands for enclosing quotation marks among context words; clean hits it is taken to have had.
MARKS, MARKS_CLEAN = '""', 20
EDGES = ".,;:!?()[]{}<>|/\\\"'`«»“”„‘’%$#&*+=~^-_…"
OPENING, CLOSING = set("\"“„«‘'"), set("\"”“»’'")


def plain(word: str) -> str:
    """A word in lower case without the marks around it."""
    return word.lower().strip(EDGES)


def terms_of(words) -> set[str]:
    """The words, and their beginnings, marked by `*`, where something follows."""
    found = set()
    for w in words:
        if len(w) >= 3:
            found.add(w)
            found.update([w[:k] + "*" for k in STEM if k < len(w)])
    return found


class Trie:
    """The lexicon's words by letters; `near` walks it with a word's Levenshtein automaton."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        # With one edit, one half of a term stays as it is: at the start or at the end of the word.
        self.heads = {w[:len(w) // 2] for w in words}
        self.tails = {w[len(w) // 2:] for w in words}
        self.sizes = sorted({len(w) // 2 for w in words} | {len(w) - len(w) // 2 for w in words})

    def near(self, word: str, edits: int = 1) -> list[str]:
        """Words of the trie within so many edits. A state of the automaton is the set of (letters of
        the word read, edits made) that a path so far allows."""
        if edits == 1 and not any(word[:k] in self.heads or word[-k:] in self.tails for k in self.sizes):
            return []
        found, stack = [], [(self.root, self._closed({0: 0}, len(word), edits))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if state.get(len(word), edits + 1) <= edits:
                        found.append(child)
                    continue
                new: dict = {}
                for at, made in state.items():
                    if at < len(word):  # the same letter, or another in its place
                        cost = made + (word[at] != c)
                        if cost <= edits:
                            new[at + 1] = min(cost, new.get(at + 1, cost))
                    if made < edits:  # a letter left out of the word
                        new[at] = min(made + 1, new.get(at, made + 1))
                if new:
                    stack.append((child, self._closed(new, len(word), edits)))
        return found

    @staticmethod
    def _closed(state: dict, size: int, edits: int) -> dict:
        """With a letter too many in the word."""
        for at in sorted(state):
            made = state[at]
            while at < size and made < edits:
                at, made = at + 1, made + 1
                if state.get(at, edits + 1) <= made:
                    break
                state[at] = made
        return state


@dataclass
class Lexicon:
    weights: dict  # term: (weight from all, from the half 0, from the half 1)
    context: dict = field(default_factory=dict)  # word near hits in clean documents: log odds of abuse, as above

    def __post_init__(self):
        self.longest = max((len(t) for t in self.weights), default=0) + 1
        self.words = {t for t in self.weights if not t.endswith("*")}
        self.stems = {t[:-1] for t in self.weights if t.endswith("*")}
        fuzzy = [t for t in self.words if len(t) >= FUZZY]
        self.trie = Trie(fuzzy)
        # Starts and ends of which one is unchanged in a misspelling, with the lengths this can have.
        self.parts: dict = {}
        for t in fuzzy:
            for part, k in ((t[:len(t) // 2], len(t) // 2), (t[len(t) // 2:], len(t) // 2 - len(t))):
                self.parts.setdefault(k, set()).update(f"{part} {n}" for n in range(len(t) - 1, len(t) + 2))

    def maybe(self, words: pa.Array) -> np.ndarray:
        """Whether a plain word may hit a term: false only where `hit` finds none."""
        found = pc.is_in(words, value_set=pa.array(sorted(self.words), words.type))
        for k in sorted({len(s) for s in self.stems}):
            own = pa.array(sorted(s for s in self.stems if len(s) == k), words.type)
            found = pc.or_(found, pc.is_in(pc.utf8_slice_codeunits(words, 0, k), value_set=own))
        size = pc.utf8_length(words).cast(words.type)
        for k, parts in sorted(self.parts.items()):
            part = pc.utf8_slice_codeunits(words, 0, k) if k > 0 else pc.utf8_slice_codeunits(words, k)
            found = pc.or_(found, pc.is_in(pc.binary_join_element_wise(part, size, pa.scalar(" ", words.type)),
                                           value_set=pa.array(sorted(parts), words.type)))
        return found.to_numpy(zero_copy_only=False)

    def hit(self, word: str) -> tuple[str, bool] | None:
        """The term that a plain word hits, and whether it is misspelled."""
        if word in self.words:
            return word, False
        stems = [word[:k] for k in STEM if word[:k] in self.stems and k <= len(word)]
        if stems:
            return max(stems, key=lambda s: self.weights[s + "*"][0]) + "*", False
        if FUZZY - 1 <= len(word) <= self.longest:
            near = self.trie.near(word)
            if near:
                return max(near, key=lambda t: (self.weights[t][0], t)), True
        return None


def hits(texts: pa.Array, lexicon: Lexicon, known: dict | None = None) -> Iterator[tuple[int, str, int, set]]:
    """Each hit: the text's number, the term, 0 if it is plain, 1 if misspelled in letters, 2 if disguised by
    other signs, and the plain words around it, with `MARKS` if quotation marks enclose it."""
    words, counts = white_words(texts)
    coded = pc.dictionary_encode(words)
    kinds, codes, doc = coded.dictionary, coded.indices.to_numpy(), owners(counts)
    clean = pc.utf8_trim(pc.utf8_lower(kinds), EDGES)
    known = {} if known is None else known
    if len(known) > 300_000:
        known.clear()
    found: dict = {}
    for k in np.flatnonzero(lexicon.maybe(clean)).tolist():
        word = clean[k].as_py()
        if word not in known:
            known[word] = lexicon.hit(word) if len(word) >= 3 else None
        if known[word]:
            term, misspelled = known[word]
            found[k] = term, int(misspelled) * (1 if word.isalpha() else 2)
    is_hit = np.zeros(max(1, len(kinds)), bool)
    is_hit[list(found)] = True
    first = np.cumsum(counts) - counts
    for at in np.flatnonzero(is_hit[codes]) if len(codes) else ():
        d = int(doc[at])
        low, high = max(first[d], at - CONTEXT), min(first[d] + counts[d], at + CONTEXT + 1)
        near = codes[low:high]
        around = set(clean.take(pa.array(np.delete(near, at - low))).to_pylist()) - {""}
        if enclosed(kinds.take(pa.array(near)).to_pylist(), int(at - low)):
            around.add(MARKS)
        yield (d, *found[int(codes[at])], around)


#: What the model knows of a document, apart from the constant: the strongest hit, and all together.
FEATURES = ("best", "total")


def strengths(texts: pa.Array, lexicon: Lexicon, halves: np.ndarray | None = None, known: dict | None = None) -> list[dict]:
    """For each text, by term, the strongest plain hit, that misspelled in letters, and that disguised by other
    signs, before the factors of the latter. `halves`: the half of the sample that each text is in, whose weights are then taken from
    the other half."""
    out: list[dict] = [{} for _ in range(len(texts))]
    for d, term, kind, around in hits(texts, lexicon, known):
        side = 0 if halves is None else 2 - int(halves[d])
        odds = min((lexicon.context[w][side] for w in around if w in lexicon.context), default=0.0)
        left = 2 / (1 + math.exp(-odds)) if odds < QUOTING else 1.0
        value = max(0.0, lexicon.weights[term][side]) * left
        kinds = out[d].setdefault(term, [0.0, 0.0, 0.0])
        kinds[kind] = max(kinds[kind], value)
    return out


def features(found: list[dict], factors: tuple[float, float]) -> np.ndarray:
    """FEATURES of texts from their `strengths`, misspelled hits counting these parts of plain ones."""
    x = np.zeros((len(found), len(FEATURES)))
    for d, terms in enumerate(found):
        values = [max(whole, factors[0] * letters, factors[1] * signs) for whole, letters, signs in terms.values()]
        if values:
            x[d] = max(values), math.log1p(sum(values))
    return x


def enclosed(words: list[str], at: int) -> bool:
    """Whether quotation marks open at or before this word, close at or after it, and not in between."""
    opened = closed = False
    for k in range(at, -1, -1):
        if k < at and words[k][-1] in CLOSING and words[k][0] not in OPENING:
            return False
        if words[k].lstrip("([{")[:1] in OPENING and words[k].lstrip("([{")[:1]:
            opened = True
            break
    for k in range(at, len(words)):
        if words[k].rstrip(".,;:!?)]}")[-1:] in CLOSING and words[k].rstrip(".,;:!?)]}")[-1:]:
            closed = True
            break
        if k > at and words[k][0] in OPENING:
            return False
    return opened and closed


@dataclass
class Toxicity:
    lexicon: Lexicon
    factors: tuple[float, float]  # of hits misspelled in letters, and disguised
    beta: np.ndarray  # of FEATURES, none below 0, and the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Coefficients, the constant last, and the loss; a feature that would count below 0 is left out."""
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        beta = np.append(np.zeros(len(used)), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        penalty = np.diag([ridge] * len(used) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ beta)
            beta = beta - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        if all(b >= 0 for b in beta[:-1]):
            p = np.clip(1 / (1 + np.exp(-np.clip(z @ beta, -30, 30))), 1e-9, 1 - 1e-9)
            whole = np.zeros(x.shape[1] + 1)
            whole[[*used, x.shape[1]]] = beta
            return whole, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        del used[int(np.argmin(beta[:-1]))]


def fit(lexicon: Lexicon, found: list[dict], y: np.ndarray) -> Toxicity:
    """The model, and the factors of misspelled hits with the least loss; where such hits are few, near
    `MISSPELLED`."""
    factors = [MISSPELLED, MISSPELLED]
    if not len(y) or not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Toxicity(lexicon, tuple(factors), np.array([0.0, 0.0, math.log(share / (1 - share))]))
    for kind in (0, 1):
        tried = []
        for value in np.linspace(0.1, 1.0, 10).tolist():
            factors[kind] = value
            _, loss = logistic(features(found, tuple(factors)), y)
            tried.append((loss + WORTH * (value - MISSPELLED) ** 2, value))
        factors[kind] = min(tried)[1]
    return Toxicity(lexicon, tuple(factors), logistic(features(found, tuple(factors)), y)[0])


def copy_marks(texts: pa.Array) -> np.ndarray:
    """`COPY_MARKS` numbers a text: the least of as many hashes over its shingles, or over all words if they are
    fewer. Near copies have most of them in common; texts without words have all the same."""
    words, counts = white_words(texts)
    coded = pc.dictionary_encode(words)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    own = hashes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    left = owners(counts) if len(own) else np.zeros(0, np.int64)
    left = np.cumsum(counts)[left] - np.arange(len(own))  # words from here to the text's end
    full = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[full]
    short = left < SHINGLE
    short[first] = False  # a text's first shingle counts, however short
    whole = np.zeros(len(own), np.uint64)
    for k in range(SHINGLE):  # what would run over the text's end is left out
        at = np.minimum(np.arange(len(own)) + k, max(0, len(own) - 1))
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + np.where(k < left, own[at], np.uint64(0))
    marks = np.zeros((len(texts), COPY_MARKS), np.uint64)
    for j in range(COPY_MARKS):
        mixed = (whole ^ np.uint64(j * 0x2545F4914F6CDD1D % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        mixed[short] = np.uint64(2**64 - 1)
        if len(full):
            marks[full, j] = np.minimum.reduceat(mixed, first)
    return marks.view(np.int64)


def without_copies(rows: DataFrame) -> DataFrame:
    """Of rows (key, text, label, half), those of which rows before them, by key, text and label, have fewer than
    `COPIED` marks: about three quarters of the shingles."""
    def marked(batches):
        for batch in slices(batches):
            marks = copy_marks(utf8(batch["text"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(marks), pa.list_(pa.int64()))],
                                             [*batch.schema.names, "marks"])

    rows = rows.withColumn("print", F.xxhash64("text"))
    rows = staged(rows.mapInArrow(marked, StructType([*rows.schema, StructField("marks", ArrayType(LongType()))])))
    order = ("key", "print", "label")
    held = rows.select(F.struct(*order).alias("row"), F.posexplode("marks").alias("at", "mark"))
    first = held.groupBy("at", "mark").agg(F.min("row").alias("first"))
    later = held.join(first, ["at", "mark"]).where("row > first").groupBy("row").agg(
        F.count_distinct("at").alias("copied")).where(F.col("copied") >= COPIED).select("row.*")
    return rows.drop("marks").join(later, list(order), "left_anti").dropDuplicates(order)


def beyond_chance(t, n, share: float, tried: int):
    """Whether t of n (columns) would be so many at this share in less than `BY_CHANCE` of `tried` cases: by
    the bound exp(-n KL) of a binomial tail."""
    p = t / n
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return (p > share) & (n * (p * F.log(p / share) + rest) > math.log(max(1, tried) / BY_CHANCE))


def log_odds(t: float, c: float, of_t: float, of_c: float) -> float:
    return math.log((t + 0.5) / (of_t + 1)) - math.log((c + 0.5) / (of_c + 1))


def train_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample: int = SAMPLE) -> Toxicity:
    """The lexicon and the model learned from the labelled documents.

    Of more than `sample` labels, those are taken whose hashed id is below a threshold that lets
    about `sample` through; their ids are broadcast. Terms and context words are counted in the tasks and
    summed by Spark; only accepted ones and the sample's hits reach the driver.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(2)).cast("int"))
    # At most about `sample` documents, read three times below.
    rows = staged(without_copies(documents.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "key").select("key", "text", "label", "half")).select("text", "label", "half"))

    def summed(count):
        def counted(batches):
            for batch in slices(batches):
                sums = [Counter() for _ in range(4)]  # by label and half
                for label, half, terms in count(batch):
                    sums[2 * label + half].update(terms)
                    sums[2 * label + half][""] += 1
                whole = sorted(set().union(*sums))
                yield pa.record_batch([pa.array(whole, pa.string()), *(pa.array([s[t] for t in whole], pa.int64()) for s in sums)],
                                      ["term", "c0", "c1", "t0", "t1"])

        # What occurs less than twice in either half can't be beyond chance in both.
        found = staged(rows.mapInArrow(counted, "term string, c0 long, c1 long, t0 long, t1 long").groupBy("term").agg(
            *[F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1")]).where("term = '' OR c0 + t0 >= 2 AND c1 + t1 >= 2"))
        return found, tuple(found.where("term = ''").select("c0", "c1", "t0", "t1").first() or (0, 0, 0, 0))

    def weighted(accepted, total):
        return {r.term: (log_odds(r.t0 + r.t1, r.c0 + r.c1, total[2] + total[3], total[0] + total[1]),
                         log_odds(r.t0, r.c0, total[2], total[0]), log_odds(r.t1, r.c1, total[3], total[1]))
                for r in accepted.orderBy("term").collect()}

    def words_of(batch):
        for text, label, half in zip(utf8(batch["text"]).to_pylist(), batch["label"].to_pylist(), batch["half"].to_pylist(), strict=True):
            yield label, half, terms_of({plain(w) for w in set(text.split())})

    found, total = summed(words_of)
    clean, toxic = total[0] + total[1], total[2] + total[3]
    base = toxic / max(1, clean + toxic)
    t, n = F.col("t0") + F.col("t1"), F.col("t0") + F.col("t1") + F.col("c0") + F.col("c1")
    weights = {}
    if 0 < base < 1:
        # A term's share of the clean documents is under a tenth of that of the toxic ones, in each half under half.
        least = math.ceil(math.log(2) / -math.log(base))
        candidates = found.where((F.col("term") != "") & (n >= least))
        leaning = (10 * (n - t) * toxic < t * max(clean, 1)) & (F.col("t0") >= 2) & (F.col("t1") >= 2)
        weights = weighted(candidates.where(leaning & beyond_chance(t, n, base, candidates.count())), total)
    lexicon = Lexicon(weights)

    def contexts(batch):
        label, half = batch["label"].to_pylist(), batch["half"].to_pylist()
        for d, _, _, around in hits(utf8(batch["text"]), lexicon):
            yield label[d], half[d], around

    if weights:
        found, total = summed(contexts)
        of_clean, of_toxic = total[0] + total[1], total[2] + total[3]
        near = found.where("term NOT IN ('', '\"\"')")
        tried, context = near.count(), {}
        if of_clean and of_toxic:
            q = of_toxic / (of_clean + of_toxic)
            accepted = near.where(beyond_chance(n - t, n, 1 - q, tried))
            context = weighted(accepted, total)
        marks = found.where(F.col("term") == MARKS).select("c0", "c1", "t0", "t1").first() or (0, 0, 0, 0)
        odds = [log_odds(a, b + MARKS_CLEAN, max(a, of_a), of_b + MARKS_CLEAN) for a, b, of_a, of_b in (
            (marks[2] + marks[3], marks[0] + marks[1], of_toxic, of_clean), (marks[2], marks[0], total[2], total[0]),
            (marks[3], marks[1], total[3], total[1]))]
        lexicon = Lexicon(weights, context | {MARKS: tuple(min(0.0, v) for v in odds)})

    def measured(batches):
        for batch in slices(batches):
            found = strengths(utf8(batch["text"]), lexicon, batch["half"].to_numpy())
            yield pa.record_batch([pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.list_(pa.float64()))),
                                   batch["label"]], ["found", "label"])

    seen = rows.mapInArrow(measured, "found map<string,array<double>>, label int").collect()
    seen = sorted(((r.label, sorted(r.found.items())) for r in seen))  # the same model in whichever order rows arrive
    return fit(lexicon, [dict(f) for _, f in seen], np.array([float(v) for v, _ in seen]))


def score_toxicity(documents: DataFrame, model: Toxicity, text_col: str = "text",
                   columns: list[str] | None = None) -> DataFrame:
    """These columns of the table, all by default, with `toxicity_score` from 0 to 1 in place of any of that name."""
    kept = [F.col(f"`{c}`") for c in columns or documents.columns if c != "toxicity_score"]
    rows = documents.select(F.struct(*kept).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("row").schema.add("score", "double")

    def scored(batches):
        known: dict = {}
        for batch in slices(batches):
            x = features(strengths(utf8(batch["text"]), model.lexicon, None, known), model.factors)
            yield pa.record_batch([batch["row"], pa.array(model.score(x))], ["row", "score"])

    return rows.mapInArrow(scored, schema).select("row.*", F.col("score").alias("toxicity_score"))
