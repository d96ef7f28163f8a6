"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The transducer reads the bytes of a pretoken; each transition carries by how much the number of
tokens changes, so that the sum over a path is the count. Its states come from a property of BPE: a
token sequence is the encoding of its text exactly if each pair of neighbours is the encoding of
theirs. So the last token of a prefix is the one token that ends there and fits the last token of
the prefix before it. What is still to come depends on the suffix that may go on as a token, and on
the last tokens and relative counts at its positions: that is a state. Transitions are compiled when
first taken.

A long text is cut into chunks. A chunk's state map is its effect whatever stands around it: the
part before its first sure boundary, the tokens inside, and the part after its last. A sure boundary
stands before white space that follows something else, as no pretoken crosses it. Maps compose
associatively, and a text's count is the pairwise scan of its chunks' maps.

Null and empty texts have no tokens. Special strings in a text are one token each, as the library
takes them by default.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Characters of a chunk.
CHUNK = 1 << 16
#: Counted pretokens, and compiled transitions, after which a worker forgets all and starts anew.
REMEMBERED = 400_000
# The pattern of pretokens that the byte-level pre-tokenizer uses.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SURE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")


@dataclass
class Bpe:
    tokens: dict  # bytes of a token: its id
    ranks: dict  # pair of ids: (rank, id of the merged token)
    special: list  # strings that are one token each


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    if whole["model"]["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["normalizer"]:
        raise ValueError("not a byte-level BPE")
    letters = byte_letters()
    special = [t["content"] for t in whole["added_tokens"]]
    vocabulary = whole["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    ranks = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(pairs)}
    tokens = {bytes(letters[c] for c in t): k for t, k in vocabulary.items() if t not in special}
    return Bpe(tokens, ranks, special)


class Transducer:
    """Compiled on the way: `step[state << 8 | byte]` is (next state, change of the count)."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.spelled = {k: t for t, k in bpe.tokens.items()}
        self.prefixes = {t[:k] for t in bpe.tokens for k in range(1, len(t) + 1)}
        self.fits: dict = {}
        self.forget()

    def forget(self) -> None:
        # A state: the suffix that may go on, the last token at each of its positions, the counts there.
        start = (b"", (-1,), (0,))
        self.states, self.numbers, self.step = [start], {start: 0}, {}

    def merged(self, ids: list[int]) -> list[int]:
        """BPE of a few tokens' bytes by definition: the lowest rank first, from the left."""
        while len(ids) > 1:
            best = min(((self.bpe.ranks.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0][0] == 1 << 60:
                break
            pair, new, out, k = (ids[best[1]], ids[best[1] + 1]), best[0][1], [], 0
            while k < len(ids):
                if tuple(ids[k:k + 2]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their text; left -1 is the start."""
        key = (left, right)
        if key not in self.fits:
            text = (self.spelled[left] if left >= 0 else b"") + self.spelled[right]
            whole = self.merged([self.bpe.tokens[text[k:k + 1]] for k in range(len(text))])
            self.fits[key] = whole == ([left] if left >= 0 else []) + [right]
        return self.fits[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        text = suffix + bytes((byte,))
        for k in range(len(text)):  # the longest first
            token = self.bpe.tokens.get(text[k:])
            if token is not None and self.fit(last[k], token):
                break
        else:
            raise ValueError("a byte is no token")
        change = counts[k] + 1
        start = next((k for k in range(len(text)) if text[k:] in self.prefixes), len(text))
        new = (text[start:], (*last[start:], token), (*(c - change for c in counts[start:]), 0))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.step[state << 8 | byte] = found = (number, change)
        return found

    def count(self, pretoken: bytes) -> int:
        if len(self.step) > REMEMBERED:
            self.forget()
        state = total = 0
        step = self.step
        for byte in pretoken:
            found = step.get(state << 8 | byte)
            state, change = found or self.compile(state, byte)
            total += change
        return total


class Counter(dict):
    """Tokens of each pretoken, counted when first asked for; `text` counts a whole text."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.transducer = Transducer(bpe)
        self.pretokens = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, bpe.special))) if bpe.special else None

    def __missing__(self, pretoken: str) -> int:
        found = self.transducer.count(pretoken.encode())
        if len(pretoken) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pretoken] = found
        return found

    def part(self, text: str) -> int:
        """Tokens of a text, or of what stands between sure boundaries."""
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pretokens.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pretokens.findall(p))) for p in parts)

    def chunk(self, text: str) -> tuple:
        """State map of a chunk: (text before the first sure boundary, tokens, text after the last); tokens
        is None if there is no boundary inside."""
        first = SURE.search(text)
        if not first:
            return text, None, ""
        cut, last = first.start(), len(text)
        # The last boundary: go back in doubling steps, so that all is not searched again.
        back = 64
        while True:
            base = max(cut, len(text) - back)
            found = [m.start() for m in SURE.finditer(text, base)]
            if found:
                last = found[-1]
                break
            back *= 2
        return text[:cut], self.part(text[cut:last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if b[1] is None and a[1] is None:
            return self.chunk(a[0] + b[0])
        if a[1] is None:
            first = self.chunk(a[0] + b[0])
            if first[1] is None:
                return first[0], b[1], b[2]
            return first[0], first[1] + self.part(first[2]) + b[1], b[2]
        middle = self.chunk(a[2] + b[0])
        if b[1] is None:
            return (a[0], a[1], middle[0]) if middle[1] is None else (
                a[0], a[1] + self.part(middle[0]) + middle[1], middle[2])
        return a[0], a[1] + self.part(a[2] + b[0]) + b[1], b[2]

    def text(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.part(text)
        maps = [self.chunk(text[k:k + chunk]) for k in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, inner, tail = maps[0]
        return self.part(head) + (inner or 0) + self.part(tail)


def token_counts(documents: DataFrame, bpe: Bpe, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """These columns of the table, all by default, with `n_bytes` and `n_tokens` of its texts in place of
    columns of these names."""
    names = [c for c in columns or documents.columns if c not in ("n_bytes", "n_tokens")]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                            F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast((bpe.tokens, bpe.ranks, bpe.special))

    def counted(batches):
        counter = Counter(Bpe(*shared.value))
        for batch in slices(batches):
            texts = utf8(batch["text"])
            yield pa.record_batch([batch["row"], pc.binary_length(texts).cast(pa.int64()),
                                   pa.array([counter.text(t) for t in texts.to_pylist()], pa.int64())],
                                  ["row", "n_bytes", "n_tokens"])

    schema = rows.select("row").schema.add("n_bytes", "long").add("n_tokens", "long")
    return rows.mapInArrow(counted, schema).select("row.*", "n_bytes", "n_tokens")
