"""Quality and toxicity: held-out accuracy, the parts of the models, awkward tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableprobe.llm import quality, toxicity
from tableprobe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
known = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@known
@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.93)])
def test_held_out(spark, name, label, least):
    scored = QUERIES[name](spark, FOLDER)
    assert scored.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    both = scored.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out")
    right, n = both.select(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert n > 50 and right >= least


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.boost(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    walked = []
    for row in x[3000:3020]:  # node by node
        total = model.base
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, model.score(x[3000:3020]))


def test_statistics_of_texts():
    texts = pa.array(["", "Hello hello\nHello hello\n", "é!", " "], pa.large_string())
    x = dict(zip(quality.NAMES, quality.statistics(texts).T, strict=True))
    assert np.isfinite(np.array(list(x.values()))).all()
    assert x["repeated_lines"][1] == pytest.approx(1 / 3) and x["log_chars"][2] == pytest.approx(np.log1p(2))


@pytest.mark.parametrize("labels", [[], [(5, 1), (6, 1)], [(5, 1), (2, 0), (None, 1), (8, None), (999, 0), (8, 7)]])
def test_few_labels(spark, awkward, empty, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    for train, score, column in ((quality.train_quality, quality.score_quality, "quality_score"),
                                 (toxicity.train_toxicity, toxicity.score_toxicity, "toxicity_score")):
        scored = score(awkward, train(awkward, known))
        assert set(awkward.columns) < set(scored.columns) and scored.count() == awkward.count()
        assert scored.where(f"{column} between 0 and 1").count() == awkward.count()
        assert score(empty, train(empty, known)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton(edits):
    r = random.Random(4)
    words = {"".join(r.choice("abc") for _ in range(r.randint(5, 8))) for _ in range(60)}
    trie = toxicity.Trie(words)
    for _ in range(300):
        word = "".join(r.choice("abc") for _ in range(r.randint(3, 9)))
        assert sorted(trie.near(word, edits)) == sorted(w for w in words if distance(w, word) <= edits)


def test_quoted_hits():
    lexicon = toxicity.Lexicon({"idiots": (5.0, 5.0, 5.0), "slur*": (4.0, 4.0, 4.0)}, {toxicity.MARKS: (-4.0, -4.0, -4.0)})
    texts = pa.array(['you idiots', 'you id1ots', 'he said "you idiots" to them', 'slurring on', 'fine words', ''], pa.large_string())
    found = [(d, term, misspelled, toxicity.MARKS in around) for d, term, misspelled, around in toxicity.hits(texts, lexicon)]
    assert found == [(0, "idiots", 0, False), (1, "idiots", 2, False), (2, "idiots", 0, True), (3, "slur*", 0, False)]
    strong = toxicity.strengths(texts, lexicon)
    assert [strong[k] for k in (0, 1, 3, 4, 5)] == [{"idiots": [5, 0, 0]}, {"idiots": [0, 0, 5]}, {"slur*": [4, 0, 0]}, {}, {}]
    assert 0 < strong[2]["idiots"][0] < 0.5
    x = dict(zip(toxicity.FEATURES, toxicity.features(strong, (0.9, 0.5)).T, strict=True))
    assert x["best"][[0, 1, 3, 4, 5]].tolist() == [5, 2.5, 4, 0, 0]


@pytest.mark.parametrize("kind", [1, 2])
def test_factors_and_signs(kind):
    """The factors of misspelled hits follow the sample, and no feature counts against toxicity."""
    lexicon = toxicity.Lexicon({})
    plain, none = {"a": [4.0, 0.0, 0.0]}, {}
    misspelled = {"a": [4.0 * (k == kind) for k in range(3)]}
    clean_ones = toxicity.fit(lexicon, [plain] * 60 + [misspelled] * 60 + [none] * 60, np.array([1.0] * 60 + [0.0] * 120))
    toxic_ones = toxicity.fit(lexicon, [plain] * 60 + [misspelled] * 60 + [none] * 60, np.array([1.0] * 120 + [0.0] * 60))
    assert clean_ones.factors[kind - 1] < toxicity.MISSPELLED <= toxic_ones.factors[kind - 1] <= 1
    for model, least, most in ((clean_ones, 0, 0.5), (toxic_ones, 0.5, 1)):
        assert least < model.score(toxicity.features([misspelled], model.factors))[0] < most
    against = toxicity.fit(lexicon, [plain] * 50 + [none] * 50, np.array([0.0] * 50 + [1.0] * 50))
    assert (against.beta[:-1] >= 0).all()


@known
def test_order_of_hits(spark):
    """Plain, misspelled, quoted and both, with a learned lexicon: plain ~ both > misspelled >> quoted > none."""
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train_toxicity(documents, labels)
    words = sorted((w for w in model.lexicon.words if len(w) >= toxicity.FUZZY and w.isascii()), key=lambda w: (-model.lexicon.weights[w][0], w))[:8]
    assert len(words) >= 3
    changed = lambda w: w[:2] + "7" + w[3:]
    kinds = (lambda w: f"You are a {w} and that is all", lambda w: f"You are a {w} and a {changed(w)} and that is all",
             lambda w: f"You are a {changed(w)} and that is all", lambda w: f'The page quotes "you are a {w}" and then goes on',
             lambda w: "You are a friend and that is all")
    scores = model.score(toxicity.features(toxicity.strengths(pa.array([k(w) for w in words for k in kinds], pa.large_string()), model.lexicon), model.factors))
    for plain, both, misspelled, quoted, none in scores.reshape(-1, 5):
        assert both >= plain > 0.5 and both - plain < 0.2
        assert plain > misspelled > quoted + 0.25 and quoted >= none and quoted < 0.5


def test_toxic_terms_that_clean_documents_quote(spark):
    # Toxic labels are rare, and half as many clean documents quote the term.
    said = ["gronkle"] * 30 + ['"gronkle"'] * 15 + ["here"] * 400
    texts = [f"a calm day in town n{k} with {w} and nothing to report at all" for k, w in enumerate(said)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, labels)
    scores = {r.doc_id: r.toxicity_score for r in toxicity.score_toxicity(df, model, columns=["doc_id"]).collect()}
    assert "gronkle" in model.lexicon.weights
    assert min(scores[k] for k in range(30)) >= 0.5 > max(scores[k] for k in range(45, len(texts)))


def test_copies_do_not_fill_the_lexicon(spark):
    r = random.Random(7)
    made = lambda n: ["".join(r.choice("abcdefghklmnorstu") for _ in range(7)) for _ in range(n)]
    story = made(80)
    copies = []
    for _ in range(60):  # near copies, each with a word of its own
        copy = list(story)
        copy[r.randrange(80)] = made(1)[0]
        copies.append(" ".join(copy))
    texts = [" ".join([*made(20), "gronkle", *made(20)]) for _ in range(40)] + copies + [" ".join(made(40)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(len(texts))], "doc_id long, toxic int")
    terms = toxicity.train_toxicity(df, labels).lexicon.weights
    assert "gronkle" in terms
    assert not set(terms) & toxicity.terms_of(story)


def test_marks_of_copies():
    r = random.Random(8)
    words = [[str(r.randrange(10**6)) for _ in range(60)] for _ in range(3)]
    near = [*words[0][:30], "other", *words[0][31:]]
    texts = [" ".join(words[0]), " ".join(near), " ".join(words[1]), "two words", "two  words ", "", None, "\t"]
    marks = toxicity.copy_marks(toxicity.utf8(pa.array(texts)))
    same = lambda a, b: int((marks[a] == marks[b]).sum())
    assert marks.shape == (8, toxicity.COPY_MARKS)
    assert same(0, 1) >= toxicity.COPIED - 3 and same(0, 2) == 0 and same(2, 3) == 0
    assert same(3, 4) == same(5, 6) == same(6, 7) == toxicity.COPY_MARKS
    assert toxicity.copy_marks(toxicity.utf8(pa.array([], pa.string()))).shape == (0, toxicity.COPY_MARKS)
    alone = [toxicity.copy_marks(toxicity.utf8(pa.array([t])))[0].tolist() for t in texts]
    assert alone == marks.tolist()  # a text's marks don't depend on its neighbours
