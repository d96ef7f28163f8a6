"""Fingerprints, decontamination, segmentation, token counts and conversations against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.llm import decontaminate, fingerprints, pieces, preferences, tokencount
from tableprobe.llm.queries import tokenizer


def paragraphs(text):
    cut = lambda part, size: set(re.findall(f"[^\n]{{1,{size}}}", part))
    return cut(text[:fingerprints.HEAD], fingerprints.FINE) | cut(text[fingerprints.HEAD:], fingerprints.PIECE)


def test_fingerprints(awkward, rows):
    table = sorted(((r["doc_id"], r["text"] or "") for r in rows), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(table):
        after = table[(k + 1) % len(table)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        near = [len(paragraphs(t) & o) / len(paragraphs(t) | o) if paragraphs(t) | o else 1.0
                for o in (paragraphs(edited), paragraphs(after))]
        want[i, len(t), edited, round(near[0], 9), round(near[1], 9)] += 1
    got = fingerprints.fingerprinted(awkward).collect()
    assert Counter((r.doc, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(r.edited, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({r.fingerprint for r in got}) > 40


@pytest.mark.parametrize("differing", [0, 1, 5, 40, 300])
def test_sketches_of_any_difference(spark, differing):
    r = random.Random(differing)
    both, a, b = ([r.getrandbits(63) for _ in range(n)] for n in (50, differing, differing // 2))
    df = spark.createDataFrame([(both + a, both + b)], "a array<bigint>, b array<bigint>")
    cells = df.select("a", "b", fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
    near, peel = cells.select(fingerprints.likeness(*map(F.col, "abxy")),
                              fingerprints.peeled(fingerprints.minus(F.col("x"), F.col("y")))).first()
    assert near == pytest.approx(50 / (50 + len(a) + len(b)))
    if not peel.rest:
        assert (set(peel.only_a), set(peel.only_b)) == (set(a), set(b))


def plain_words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits(text, items, size):
    words, covered, found = plain_words(text), set(), set()
    for item, body in items:
        w = plain_words(body)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            gram = w[k:k + size]
            for at in range(len(words) - len(gram) + 1):
                if words[at:at + len(gram)] == gram:
                    covered.update(range(at, at + len(gram)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(covered), tuple(sorted(found))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, awkward, rows, limit):
    shared = next(r["text"] for r in rows if r["doc_id"] == 8)
    items = [(1, shared), (2, None), (3, ""), (4, "two  THREE"), (5, "x"), (5, "text-of the Same id"), (None, "one"), (6, shared[:90])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    found = decontaminate.benchmark_hits(awkward, benchmark, limit=limit)
    got = Counter((r.row.doc_id, r.row.text, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())
    assert got == Counter((r["doc_id"], r["text"], *hits(r["text"], items, 13)) for r in rows)
    kept = decontaminate.decontaminate(awkward, benchmark)
    assert kept.columns == awkward.columns
    clean = Counter()
    for r in rows:
        n, hit, _ = hits(r["text"], items, 13)
        if not (hit and 20 * hit >= n):
            clean[r["doc_id"], r["text"]] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == clean
    for r in decontaminate.decontaminate(awkward, benchmark, remove="spans").where("doc_id in (8, 9, 15)").collect():
        assert not hits(r.text, [(1, shared), (4, "two three")], 13)[1]


def test_decontamination_of_nothing(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(awkward, none).count() == awkward.count()
    assert decontaminate.decontaminate(empty, none).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(tokenizer("piece_bpe_32k.model"))


def all_scores(v, text, count):
    """The best scores over all paths, kept at each position."""
    if not text:
        return [0.0]
    s = pieces.SPACE + text.replace(pieces.SPACE, pieces.OWN).replace(" ", pieces.SPACE)
    best = [[0.0]]
    for stop in range(1, len(s) + 1):
        here = []
        for start in range(max(0, stop - 20), stop):
            found = v.table.get(s[start:stop])
            score = found[0] if found else v.penalty if start == stop - 1 else None
            if score is not None:
                here += [x + score for x in best[start]]
        best.append(sorted(here, reverse=True)[:count])
    return best[-1]


def test_segmentation(vocabulary):
    r = random.Random(1)
    solved = pieces.Solved(vocabulary)
    for _ in range(300):
        text = "".join(r.choice(["a", "the", " ", "  ", "\n", "in", "é", "你", "▁", "er", "x", "퟿"]) for _ in range(r.randint(0, 9)))
        found = pieces.encode_all(solved, text, 4)
        assert [s for s, _ in found] == pytest.approx(all_scores(vocabulary, text, 4))
        assert len({tuple(i) for _, i in found}) == len(found)
        assert all(pieces.decode(vocabulary, i) == text for _, i in found)


def test_words_solved_together(vocabulary):
    r = random.Random(2)
    words = ["▁" + "".join(r.choice("aeinrsté你\n9") for _ in range(r.randint(0, 20))) for _ in range(400)]
    assert pieces.solve_many(vocabulary, words) == [pieces.solve(vocabulary, w) for w in words]
    assert pieces.solve_many(vocabulary, []) == []


def test_repeated_words_are_listed_once(vocabulary, monkeypatch):
    listed = []
    plain = pieces.best_paths
    monkeypatch.setattr(pieces, "best_paths", lambda v, word, count: listed.append(word) or plain(v, word, count))
    solved = pieces.Solved(vocabulary)
    text = " ".join(["the", "reading", "thereof"])
    first = [pieces.encode_all(solved, text, 4) for _ in range(3)]
    assert first[0] == first[1] == first[2] and len(listed) == len(set(listed)) > 0
    long = "reading" * 20
    assert [s for s, _ in pieces.encode_all(solved, long, 4)] == pytest.approx(all_scores(vocabulary, long, 4))


def test_codes_of_pieces_are_found(vocabulary):
    codes = vocabulary.codes
    assert (pieces.rows_of(vocabulary, codes) == np.arange(len(codes))).all()
    others = np.array([0, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)], np.uint64)
    assert (pieces.rows_of(vocabulary, others) == np.minimum(np.searchsorted(codes, others), len(codes) - 1)).all()


def test_segmented_table(awkward, empty, vocabulary):
    found = pieces.segmented(awkward, vocabulary).collect()
    assert len(found) == awkward.count() and all(r.restored for r in found)
    solved = pieces.Solved(vocabulary)
    for r in found:
        if len(r.text or "") < 200:
            assert r.nbest_scores == pytest.approx([s for s, _ in pieces.encode_all(solved, r.text or "", 4)])
            assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.piece_ids)).hexdigest()
    assert pieces.segmented(empty, vocabulary).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return tokencount.load(tokenizer("byte_bpe_50k.json"))


def test_token_counts(awkward, empty, bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for r in tokencount.token_counts(awkward, bpe).collect():
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert tokencount.token_counts(empty, bpe).count() == 0


def test_chunks_compose(bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    counter, r = tokencount.Counter(bpe), random.Random(3)
    parts = ["'s", "'", "'ll", " ", "  ", "\n", "a", "the", "é", "你", "1", "23", "!", "<|endoftext|>", "\t", "　", "ing", "<|", "\x1c"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.part(text) == want
        assert all(counter.text(text, k) == want for k in (1, 3, 7))


def turns(*parts):
    return [{"role": r, "text": t} for r, t in parts]


def test_preferences(spark):
    a = turns(("user", "q"), ("assistant", "one"), ("user", "more"), ("assistant", "two"))
    b = turns(("user", "q"), ("assistant", "one"), ("user", "other"), ("assistant", "three"))
    df = spark.createDataFrame([(1, a, b, 5), (2, a, a, 5), (3, a, [], 5), (4, None, b, 5), (5, a, a[:2], 5)],
                               "id int, chosen array<struct<role:string,text:string>>, "
                               "rejected array<struct<role:string,text:string>>, _shared int")
    got = {r.id: r for r in preferences.format_preferences(df).collect()}
    assert [got[k].prompt_turns for k in range(1, 6)] == [2, 4, 0, 0, 2]
    assert got[1].prompt == "<|user|>\nq<|end|>\n<|assistant|>\none<|end|>\n"
    assert got[1].rejected == "<|user|>\nother<|end|>\n<|assistant|>\nthree<|end|>\n"
    assert [got[1].rejected[s.start:s.stop] for s in got[1].rejected_trained] == ["three<|end|>\n"]
    assert (got[2].chosen, got[2].rejected, got[2].chosen_trained) == ("", "", [])
    assert (got[3].prompt, got[3].rejected) == ("", "") and len(got[3].chosen_trained) == 2
    assert got[4].chosen == "" and got[5].rejected == "" and len(got[5].chosen_trained) == 1


def test_conversations(spark):
    df = spark.createDataFrame(
        [(2, 1, "assistant", "b"), (2, 0, "user", "q"), (3, 0, "user", None), (5, 0, "assistant", None), (7, None, None, "x"),
         (None, 0, "assistant", "n"), (5, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in preferences.mismatched(preferences.conversations_of(df)).collect()}
    assert set(got) == {2, 3, 5, 7, None}
    assert [t.text for t in got[2].rejected] == ["q", ""] and [t.text for t in got[5].rejected] == ["", "n"]
    assert [t.text for t in got[None].rejected] == ["b"] and got[7].chosen == got[7].rejected
    assert preferences.mismatched(preferences.conversations_of(df.limit(0))).count() == 0
