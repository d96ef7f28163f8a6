import random

import pytest

#: Columns whose names the operators use themselves.
EXTRA = ("row", "doc", "key", "words", "mark", "at", "score", "n_words", "codes", "starts", "component", "label", "_span")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, copies and clashing columns."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(40)
    base = "\n".join(line(30) for _ in range(6))
    near = base.replace(base.split(" ")[50], "changed", 1)
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, " ".join(word() for _ in range(30_000))), (5, base), (6, base),
             (6, base), (7, near), (8, shared), (9, f"{line(20)}\n{shared}\n{line(20)}"), (10, f"{line(9)} {shared} {line(9)}"),
             (11, "x"), (11, "another text of the same id " + shared), (None, base), (None, None), (None, "text without id"),
             (12, "Ünïcödé ▁   ß 你好 😀 \x00 <|endoftext|> it's 'll  two  spaces\r\n"), (13, "A" * 5000), (14, "\n\n\n"),
             (15, "one two three\none two three\nthree two one\none two"), (-3, shared.upper())]
    texts += [(100 + k, "\n".join(line(r.randint(1, 25)) for _ in range(r.randint(1, 5)))) for k in range(30)]
    rows = [(i, t, "en", "s", *[k] * len(EXTRA)) for k, (i, t) in enumerate(texts)]
    r.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def rows(awkward):
    return [r.asDict() for r in awkward.collect()]
