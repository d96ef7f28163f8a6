"""Hard negatives and whitening against plain numpy, on random and on awkward vectors."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.llm import negatives
from tableprobe.llm.negatives import hilbert_keys, mine_hard_negatives
from tableprobe.llm.queries import QUERIES
from tableprobe.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x int, `count` int, block int, deviation int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", k, k, k, k) for k, r in enumerate(rows)], SCHEMA).repartition(3)


def random_rows(count, width, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = centres[rng.integers(0, 6, count)] + rng.normal(size=(count, width)) * 0.7
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(k, v.astype(np.float32).tolist(), int(rng.integers(0, 4))) for k, v in enumerate(x)]


AWKWARD = [
    (None, [0.5, 0.25], 1), (50, None, 1), (100, [0.5, None], 1), (150, [0.5, float("nan")], 2), (200, [float("inf"), 1.0], 2),
    (250, [], 1), (300, [0.5], 1), (350, [0.5, 0.25, 0.125], None), (400, [0.5, 0.25], 1), (400, [0.5, 0.25], 1), (400, [0.25, 0.25], 2),
    (-50, [-0.5, 0.5], 2), (451, [1e30, -1e30], 3), (500, [0.0, 0.0], 3), (501, [0.5, 0.25], 2), (502, [0.5, 0.2], 2),
]


def usable(rows):
    width = max((len(r[1]) for r in rows if r[1] is not None), default=0)
    return [(r[0], [*r[1], *[0.0] * (width - len(r[1]))], r[2]) for r in rows
            if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def mined_by_hand(rows, positives=5, wanted=3):
    whole = lambda c: max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(c)))))
    rows = [(r[0], [whole(c) for c in r[1]], r[2]) for r in usable([r for r in rows if r[2] is not None])]
    score = lambda a, b: sum(p * q for p, q in zip(a[1], b[1], strict=True))
    last = lambda r: (r[0] is None, r[0] or 0)
    out = Counter()
    for k, a in enumerate(rows):
        if a[0] is None or a[0] % 50:
            continue
        others = sorted(((score(a, b), b) for j, b in enumerate(rows) if j != k), key=lambda p: (-p[0], last(p[1])))
        for s, p in [o for o in others if o[1][2] == a[2]][:positives]:
            hits = [(t, n) for t, n in others if n[2] != a[2] and 50 * s <= 100 * t <= 95 * s]
            for rank, (t, n) in enumerate(hits[:wanted], 1):
                out[(a[0], p[0], rank, n[0], s, t)] += 1
    return out


def mined(spark, rows):
    found = mine_hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0)
    return Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("count", "width", "block", "zones"), [(1500, 8, 64, 4), (900, 3, 32, 256), (700, 64, 512, 256)])
def test_negatives_brute_force(spark, monkeypatch, count, width, block, zones):
    for name, value in (("SMALL", block), ("LARGE", block), ("ZONES", zones), ("TILE", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = random_rows(count, width)
    rows += [(10_000 + 25 * k, rows[7][1], k % 3) for k in range(300)]  # a group of copies
    assert mined(spark, rows) == mined_by_hand(rows)


def test_awkward_negatives(spark):
    assert mined(spark, AWKWARD) == mined_by_hand(AWKWARD)
    assert mined(spark, [r for r in AWKWARD if r[1] is None]) == Counter()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == Counter()  # no anchor
    assert mine_hard_negatives(table(spark, AWKWARD).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold(spark):
    """No inner product lies outside the bounds of its zone map."""
    rng = np.random.default_rng(3)
    low = rng.normal(size=(64, 4)) * 0.02 + [1, 0, 0, 0]
    far = rng.normal(size=(640, 4)) * 0.02 - [1, 0, 0, 0]
    least, most = negatives.bounds((low[:1] * 256).astype(np.int64), *[(f(far, 0) * 256).astype(np.int64)[None] for f in (np.min, np.max)])
    assert most[0, 0] < 0 and least[0, 0] < most[0, 0]
    for _ in range(200):
        box, a = rng.integers(-9, 9, (2, 5)), rng.integers(-9, 9, (1, 5))
        x = rng.integers(box.min(0), box.max(0) + 1, (50, 5))
        least, most = negatives.bounds(a, box.min(0)[None], box.max(0)[None])
        assert (a @ x.T >= least).all() and (a @ x.T <= most).all()


def test_hilbert_curve():
    """Each cell once, and neighbours along the curve differ by one step in one dimension."""
    for width, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width), -1).reshape(-1, width)
        keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walked = cells[np.argsort(np.array(keys, dtype=object))]
        assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


def whitened_by_hand(rows, components=16):
    rows = usable(rows)
    x = [tuple(max(-(1 << 40), min(1 << 40, math.floor(64 * float(np.float32(c))))) + 1_000_000 for c in r[1]) for r in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    variances, vectors = np.linalg.eigh(y.T @ y / n)
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    z = {v: np.abs(w @ vectors[:, ::-1][:, :components] / np.sqrt(np.maximum(variances[::-1][:components], 1e-300))) for v, w in zip(fit, y, strict=True)}
    return n, variances[::-1][:components], variances.sum(), list(zip([r[0] for r in rows], deviations, [z[v] for v in x], strict=True))


@pytest.mark.parametrize("width", [4, 24])
def test_whitening_brute_force(spark, width):
    rows = random_rows(800, width, 5)
    rows += [(5000 + k, rows[3][1], 0) for k in range(600)] + [(6000 + k, rows[4 + k % 2][1], 0) for k in range(40)]
    n, variances, trace, expected = whitened_by_hand(rows)
    found = whiten(table(spark, rows)).select("row.vec_id", "row.x", "n", "deviation", "whitened", "explained", "identity_error").collect()
    assert len(found) == len(rows) and {r.n for r in found} == {n}
    by_id = {e[0]: e for e in expected}
    for r in found:
        _, deviation, z = by_id[r.vec_id]
        assert int(r.deviation) == deviation
        assert np.allclose(np.abs(r.whitened), z, atol=1e-8) and len(r.whitened) == min(16, width)
        assert np.allclose(r.explained, variances / trace, rtol=1e-9) and r.identity_error < 1e-9
    signs = defaultdict(list)  # one orientation for all rows: equal vectors are equal
    for r in found:
        if r.vec_id >= 5000:
            signs["same" if r.vec_id < 6000 else r.vec_id % 2].append(tuple(r.whitened))
    assert [len(set(z)) for z in signs.values()] == [1, 1, 1]


def test_weights_by_count(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    assert {r.n for r in whiten(table(spark, rows)).collect()} == {3}
    found = whiten(table(spark, rows), weights="count").collect()
    assert {r.n for r in found} == {4} and found[0].identity_error < 1e-12
    z = np.array([r.whitened for r in found])
    assert np.allclose(z.T @ z / 4, np.eye(2)) and np.allclose(z.mean(0), 0)


def test_awkward_whitening(spark):
    rows = [r for r in AWKWARD if r[0] != 451]
    found = whiten(table(spark, rows)).select("row.vec_id", "n", "deviation", "whitened").collect()
    n, _, _, expected = whitened_by_hand(rows)
    assert Counter((r.vec_id, r.n, int(r.deviation)) for r in found) == Counter((e[0], n, e[1]) for e in expected)
    assert whiten(table(spark, rows).limit(0)).count() == 0
    assert {len(r.whitened) for r in whiten(table(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])).collect()} == {0}
    far = whiten(table(spark, AWKWARD)).select("row.vec_id", "deviation").collect()  # 1e30 counts as 2^40
    assert Counter((r.vec_id, int(r.deviation)) for r in far) == Counter((e[0], e[1]) for e in whitened_by_hand(AWKWARD)[3])


def test_registered(spark, tmp_path):
    rows = random_rows(300, 24, 9)
    table(spark, rows + AWKWARD[:3]).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect()
    n, variances, trace, expected = whitened_by_hand(rows + AWKWARD[:3])
    assert len(found) == 16 * len(expected) and found[0].n == n
    by_id = {e[0]: e for e in expected}
    for r in found:
        assert abs(abs(r.whitened) - by_id[r.vec_id][2][r.component - 1]) < 1e-8 and r.deviation == by_id[r.vec_id][1]
        assert r.explained == pytest.approx(variances[r.component - 1] / trace)
    relabelled = [(r[0], r[1], (r[2] + 1) % 10 if r[2] is not None and r[0] is not None and r[0] % 7 == 0 else r[2]) for r in rows + AWKWARD[:3]]
    found = Counter(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect())
    assert found == mined_by_hand(relabelled)
