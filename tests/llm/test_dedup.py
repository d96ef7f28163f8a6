"""Substring, near and line dedup against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tableprobe.llm import lines, simhash, substring


def white(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def removed_words(table, size):
    """For each row the kept words, by the definition."""
    first = {}
    for i, t in table:
        w = white(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in table:
        w = white(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [13, 3])
def test_substring(awkward, rows, window):
    found = substring.deduplicate_substrings(awkward, window=window, cells=1 << 16)
    assert set(awkward.columns) <= set(found.columns) | {"n_words"}
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    assert got == removed_words([(r["doc_id"], r["text"]) for r in rows], window)


def test_a_full_sketch_loses_nothing(awkward, rows, monkeypatch):
    monkeypatch.setattr(substring, "repeated", lambda bits, keys, cells: np.ones(len(keys), bool))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text)
                  for r in substring.deduplicate_substrings(awkward, cells=1 << 16).collect())
    assert got == removed_words([(r["doc_id"], r["text"]) for r in rows], 13)


def test_estimates_are_never_too_low():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(2654435761)
    bits = np.zeros(substring.ROWS * (1 << 16) // 8, np.uint8)
    for row in range(substring.ROWS):
        counts = np.bincount(substring.cells_of(np.repeat(keys[:100], 2), row, 1 << 16), minlength=1 << 16)
        bits[row << 13:(row + 1) << 13] = np.packbits(counts >= 2)
    assert substring.repeated(bits, keys[:100], 1 << 16).all()
    assert substring.repeated(bits, keys[100:], 1 << 16).mean() < 0.05


def slow_fingerprint(text, size):
    w = white((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(w[k:k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def groups(values, distance):
    label = list(range(len(values)))
    for _ in values:
        for a in range(len(values)):
            for b in range(len(values)):
                if (values[a] ^ values[b]).bit_count() <= distance:
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash(awkward, rows):
    rows = [r for r in rows if len(r["text"] or "") < 20_000]
    prints = [slow_fingerprint(r["text"], 4) for r in rows]
    label = groups(prints, 4)
    least = defaultdict(list)
    for r, k in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[k].append(r["doc_id"])
    want = Counter((r["doc_id"], p, min(least[k], default=None)) for r, p, k in zip(rows, prints, label, strict=True))
    got = simhash.near_groups(awkward.where("text is null or length(text) < 20000")).collect()
    assert Counter((r.doc, r.fingerprint % 2**64, r.component) for r in got) == want


def test_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**64, 8, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centers for _ in range(60)}
    values |= {int(v) for v in rng.integers(0, 2**64, 100, dtype=np.uint64)}
    values = sorted(values)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long")
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.stars(simhash.near_links(df, chunk=20)).collect()}
    label = groups(values, 4)
    assert len({found.get(v, v) for v in values}) == len(set(label))
    pairs = {(found.get(v, v), k) for v, k in zip(values, label, strict=True)}
    assert len(pairs) == len(set(label))


def roots_of(count, pairs):
    """For each node the least of its connected group."""
    label = list(range(count))
    for _ in range(count):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


PATH = (0, 5, 4, 9, 8, 3, 7, 2, 6, 1)


@pytest.mark.parametrize("seed", [None, *range(40)])
def test_links_keep_each_group_connected(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    count = len(PATH) if seed is None else int(rng.integers(2, 60))
    pairs = list(zip(PATH, PATH[1:])) if seed is None else [
        tuple(int(k) for k in rng.choice(count, 2, replace=False)) for _ in range(int(rng.integers(1, count + 1)))]
    joined = {frozenset(p) for p in pairs}
    # Values that stand for the nodes; which of them are near is given.
    values = np.arange(count, dtype=np.uint64)
    near = np.array([[64 * (frozenset((a, b)) not in joined) for b in range(count)] for a in range(count)])

    class Bits:
        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_count(self, x):
            return np.zeros(x.shape, np.uint8) if x.ndim == 2 else next(distances)

    def distances_of():
        for shift in range(1, count):
            yield near[np.arange(count - shift), np.arange(shift, count)]

    distances = distances_of()
    monkeypatch.setattr(simhash, "np", Bits())
    u, v = simhash.links(values, np.zeros(count, int), np.zeros(count, int))
    assert roots_of(count, zip(u.tolist(), v.tolist(), strict=True)) == roots_of(count, pairs)


def test_links_of_chained_fingerprints():
    # A walk that changes four bits a step: each value is linked to the next, and few others are.
    for seed in range(30):
        rng = np.random.default_rng(seed)
        walk = [int(rng.integers(0, 2**64, dtype=np.uint64))]
        for _ in range(80):
            walk.append(walk[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
        values = np.array(sorted(set(walk)), np.uint64)
        u, v = simhash.links(values, np.zeros(len(values), int), np.zeros(len(values), int))
        at = {int(x): k for k, x in enumerate(values)}
        found = roots_of(len(values), [(at[int(a)], at[int(b)]) for a, b in zip(u, v, strict=True)])
        assert set(found) == {0}


@pytest.mark.parametrize("count", [1, 10**6, 10**9, 10**12])
def test_blocks_keep_each_link(count):
    blocks = simhash.blocks_for(count)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 200, dtype=np.uint64)
    b = np.array([int(x) ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for x in a], np.uint64)
    shared = np.zeros(len(a), bool)
    for x, y in zip(simhash.block_keys(a, blocks), simhash.block_keys(b, blocks), strict=True):
        shared |= x == y
    assert shared.all()


def test_one_document_of_a_group_stays(awkward, rows):
    kept = simhash.deduplicate_near(awkward, shingle=5)
    assert kept.columns == awkward.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    prints = {(r["doc_id"], r["text"]): simhash.fingerprint((r["text"] or "").encode(), 5) for r in rows}
    keys = list(prints)
    label = dict(zip(keys, groups([prints[k] for k in keys], 4), strict=True))
    assert Counter(label[k] for k in got) == Counter(set(label.values()))
    for k in got:
        assert k[0] == min((i for i, t in keys if label[i, t] == label[k] and i is not None), default=None)


def test_the_pipeline_keeps_one_of_each_group(awkward, rows):
    kept = corpus_pipeline.near_dedup(awkward.sparkSession, awkward, "")
    assert kept.columns == awkward.columns
    prints = {(r["doc_id"], r["text"]): slow_fingerprint(r["text"], 4) for r in rows}
    keys = list(prints)
    label = dict(zip(keys, groups([prints[k] for k in keys], 4), strict=True))
    assert Counter(label[r.doc_id, r.text] for r in kept.collect()) == Counter(set(label.values()))


def repeated(table, threshold=0.8):
    """(id, text, position) of lines that go, by all pairs."""
    order = sorted({t for t in table if t[1] is not None}, key=lambda t: (t[0] is not None, t[0] or 0))
    seen, gone = [], set()
    for i, t in order:
        for k, line in enumerate(t.split("\n")):
            words = frozenset(w for w in line.split(" ") if w)
            if words:
                if any(len(words & s) >= threshold * len(words | s) for s in seen):
                    gone.add((i, t, k))
                seen.append(words)
    return gone


@pytest.mark.parametrize("hot", [24, 1])
def test_lines(awkward, rows, hot):
    # Ids that stand for several texts have no order among these.
    many = {i for i in [r["doc_id"] for r in rows] if len({r["text"] for r in rows if r["doc_id"] == i}) > 1}
    table = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in many]
    df = awkward.where("doc_id is not null and doc_id not in (" + ",".join(str(i) for i in many if i is not None) + ")")
    want = Counter((i, k) for i, _, k in repeated(table))
    got = lines.repeated_lines(df, hot=hot).collect()
    assert Counter((r.doc, r["at"] & 0xFFFFFFFF) for r in got) == want


@pytest.mark.parametrize("hot", [24, 2])
def test_lines_of_near_copies(spark, hot, monkeypatch):
    monkeypatch.setattr(lines, "LARGE", 30)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(12)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 12))] = f"v{int(rng.integers(0, 6))}"
        texts.append((k, " ".join(words[:int(rng.integers(4, 13))])))
    got = {(r.doc, 0) for r in lines.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string"), hot=hot).collect()}
    assert got == {(i, k) for i, _, k in repeated(texts)}


@pytest.mark.parametrize("threshold, few, hot", [(0.8, 3, 2), (0.5, 1, 2)])
def test_lines_that_share_frequent_words(spark, threshold, few, hot, monkeypatch):
    """Words of more than `few` lines are met as pairs, some of them large; no link is lost, also where
    similar lines may share one word only."""
    monkeypatch.setattr(lines, "LARGE", 30)
    monkeypatch.setattr(lines, "FEW", few)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(70):
        words = [f"w{int(w)}" for w in rng.choice(14, int(rng.integers(1, 13)), replace=False)]
        texts.append((None if k == 40 else 100 - k, " ".join([*words, *(f"own{k}_{i}" for i in range(int(rng.integers(0, 2))))])))
    got = {(r.doc, 0) for r in lines.repeated_lines(
        spark.createDataFrame(texts, "doc_id long, text string"), threshold=threshold, hot=hot).collect()}
    assert got == {(i, k) for i, _, k in repeated(texts, threshold)}


def test_words_of_some_hundred_lines_make_no_pairs(spark, monkeypatch):
    """Only words of more than a thousand lines are met as pairs, and none in 800 lines is."""
    made = []
    plain = lines.staged

    def spied(df):
        if (table := plain(df)).columns[:2] == ["word", "a"]:
            made.append(table.count())
        return table

    monkeypatch.setattr(lines, "staged", spied)
    rng = np.random.default_rng(11)
    texts = [(k, " ".join(f"w{w}" for w in rng.choice(24, int(rng.integers(8, 14)), replace=False))) for k in range(800)]
    got = {(r.doc, 0) for r in lines.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(i, k) for i, _, k in repeated(texts)}
    assert made == [0]


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_lines_and_those_not_larger(spark, threshold):
    """Copies that lose or gain words, up to the least similarity: each is met by the larger of the two, whichever comes first."""
    rng = np.random.default_rng(13)
    texts = []
    for k in range(40):
        base = [f"b{k}_{i}" for i in range(int(rng.integers(4, 40)))]
        for _ in range(5):
            words = base[int(rng.integers(0, 1 + len(base) // 3)):] + [f"n{len(texts)}_{i}" for i in range(int(rng.integers(0, 1 + len(base) // 5)))]
            texts.append((1000 - len(texts) * 7 % 1000, " ".join(rng.permutation(words))))
    got = {(r.doc, 0) for r in lines.repeated_lines(
        spark.createDataFrame(texts, "doc_id long, text string"), threshold=threshold).collect()}
    want = {(i, k) for i, _, k in repeated(texts, threshold)}
    assert got == want and 20 < len(want) < 180


def test_a_group_of_near_copies_is_not_met_again(spark, monkeypatch):
    """Lines that share frequent words but no later line: what joins to be verified grows with the lines."""
    monkeypatch.setattr(lines, "FEW", 2)
    made = []
    plain = lines._similar
    monkeypatch.setattr(lines, "_similar", lambda pairs, *more: made.append(pairs.count()) or plain(pairs, *more))
    base = [f"w{k}" for k in range(30)]
    for many in (60, 120):
        texts = [(k, " ".join([*base, f"own{k}"])) for k in range(many)]
        found = lines.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string"), hot=4)
        assert sorted(r.doc for r in found.collect()) == list(range(1, many))
    assert made[1] == made[3] == 0 and made[2] <= 2.5 * made[0]


def test_line_dedup_keeps_the_rest(awkward):
    kept = lines.deduplicate_lines(awkward)
    assert kept.columns == awkward.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(1, None), (2, ""), (14, "\n\n\n")} <= got
    assert (15, "one two three\none two") in got
    assert not any(i == 6 for i, _ in got)


def test_empty_tables(empty):
    assert substring.deduplicate_substrings(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.deduplicate_near(empty).columns == empty.columns
    assert lines.deduplicate_lines(empty).count() == 0


def test_lines_of_words_with_one_hash(spark):
    """`w254943` and `w267111` have one 32-bit hash; lines that differ in such words alone are not equal."""
    words = spark.createDataFrame([("w254943", "w267111")], "a string, b string")
    assert words.selectExpr("hash(a) = hash(b)").first()[0]
    six = "alpha beta gamma delta epsilon"
    texts = [(1, "w254943"), (2, "w267111"), (3, f"w254943 {six[:16]}"), (4, f"{six[:16]} w267111"), (5, "w254943 w267111"),
             (6, f"{six} zeta eta theta w254943"), (7, f"{six} zeta eta theta w267111")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc for r in lines.repeated_lines(df).collect()) == [7]
    assert sorted(r.doc_id for r in lines.deduplicate_lines(df).collect()) == [1, 2, 3, 4, 5, 6]


def test_registered_line_dedup(spark, awkward, rows, tmp_path):
    """The registered query against all pairs, over ids that stand for one text."""
    from tableprobe.llm.queries import QUERIES

    many = {i for i in [r["doc_id"] for r in rows] if len({r["text"] for r in rows if r["doc_id"] == i}) > 1}
    table = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in many and r["doc_id"] is not None]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert len(found) == len(table)
    want = {(i, k) for i, _, k in repeated(table)}
    assert {(r.doc_id, int(p)) for r in found for p in r.removed_lines.split(",") if p} == want
    assert all(r.n_removed == sum(i == r.doc_id for i, _ in want) for r in found)
    sizes = Counter((i, 0 if t is None else t.count("\n") + 1) for i, t in table)
    assert Counter((r.doc_id, r.n_lines) for r in found) == sizes


def test_lines_with_runs_of_spaces(spark):
    """Empty words between spaces count for nothing where pairs are verified, also in rows that repeat."""
    ten = [f"w{k}" for k in range(10)]
    texts = [(1, "  ".join(ten)), (1, "  ".join(ten)), (2, "  ".join(ten[:8] + ["x", "y"])), (3, "  ".join(ten[:9] + ["z"])),
             (4, " ".join(ten[:8]) + "   v"), (5, "   ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter(i for i, _, _ in repeated(sorted(set(texts))))
    assert Counter(r.doc for r in lines.repeated_lines(df).collect() if r.doc != 1) == want


def test_staged_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from tableprobe.llm.common import CLEANUP, staged

    roots = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f.name for r in roots for f in Path(r).rglob("shuffle_*")}
    before, setting = held(), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()
    table = staged(df)
    end = time.time() + 20
    while (left := {n for n in held() - before if n.endswith(".data")}) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP, None) == setting
    assert table.count() == 10
