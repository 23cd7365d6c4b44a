"""Hard negatives and centroids against brute force: ties, repeated rows, odd vectors, many blocks, empty tables."""

import hashlib

import numpy as np
import pytest

from corpusmill.llm import centroids, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, part int, n int"
ODD = [(9001, None, 1), (9002, [0.5, None], 1), (9003, [float("nan")] * 4, 1), (9004, [float("inf"), 0.0, 0.0, 0.0], 2), (9005, [0.1, 0.2, 0.3, 0.4], None), (None, [0.1, 0.2, 0.3, 0.4], 1), (9006, [0.1, 0.2], 1), (9008, [], 1), (9050, [], 1), (9009, [], 2)]


def rows(n, dim=4, labels=3, seed=0, coarse=3):
    """Coarse components make many ties; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * coarse) / coarse
    x[rng.random(n) < 0.33] = x[0]
    return [(i, [float(v) for v in x[i]], int(rng.integers(labels)) if rng.random() < 0.6 else 0) for i in range(n)]


def frame(spark, found):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in found], SCHEMA)


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def mined(found, asks, positives=5, negatives=3, low=50, high=95):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in found if i is not None and label is not None and fine(v)]
    anchors = {}
    for i, v, label in sorted((r for r in kept if asks(r[0])), key=lambda r: (r[0], r[2], r[1])):
        anchors.setdefault(i, (i, v, label))
    out = []
    for i, v, label in anchors.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in kept if j != i and len(w) == len(v))
        for score, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, k) for s, k, other in scored if other != label and low * -score <= 100 * -s <= high * -score]
            out += [(i, j, rank, k, -score, -s) for rank, (s, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("tiny", [False, True])
def test_hard_negatives(spark, monkeypatch, tiny):
    if tiny:  # many blocks, leaves and cells
        monkeypatch.setattr(hard_negatives, "CANDIDATES", (40, 4))
        monkeypatch.setattr(hard_negatives, "ANCHORS", (8, 2))
        monkeypatch.setattr(hard_negatives, "CELL_CANDIDATES", 100)
        monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 10)
        monkeypatch.setattr(hard_negatives, "LEAVES", 2)
    found = rows(600) + ODD + rows(600)[:30]
    vectors = frame(spark, found)
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors, vectors.where("vec_id % 10 = 0")).collect())
    assert got == mined(found, lambda i: i % 10 == 0) and len(got) > 300


def test_hard_negatives_far_apart(spark):
    """Clusters far from each other, so that whole groups are pruned."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 4
    found = [(i, [float(x) for x in centre[i % 6] + rng.normal(size=8) * 0.1], i % 6 // 2) for i in range(900)]
    vectors = frame(spark, found)
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors, vectors.where("vec_id % 50 = 0"), positives=2).collect())
    assert got == mined(found, lambda i: i % 50 == 0, positives=2)


def test_no_hard_negatives(spark):
    none = frame(spark, rows(5)).where("false")
    assert hard_negatives.mine(none, none).collect() == []
    one = frame(spark, rows(5, labels=1))
    assert hard_negatives.mine(one, one).collect() == []


def clustered(found, k, rounds, dim, seed=2):
    kept = [(i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v])) for i, v, _ in found if fine(v) and len(v) == dim]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)
    c = [np.array(v) for _, v in order[:k]]
    near = lambda v: min((int(((v - m) ** 2).sum()), n) for n, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [np.array([int(s) // at.count(n) for s in sum(v for (_, v), a in zip(kept, at) if a == n)]) if n in at else m for n, m in enumerate(c)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    own = {n: sum(d for _, m, d in last if m == n) for n in range(len(c))}
    return sorted(((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, c[n].tolist())).encode()).hexdigest()) for i, n, d in last), key=str)


@pytest.mark.parametrize("k", [7, 2000])
def test_centroids(spark, k):
    found = rows(400, dim=12) + [(i, v, 0) for i, v, _ in rows(400, dim=12)[:20]] + ODD + [(None, [0.1] * 12, 1)]
    got = centroids.cluster(frame(spark, found), k=k, rounds=3, dim=12)
    assert sorted((tuple(r) for r in got.collect()), key=str) == clustered(found, k, 3, 12)


def test_no_centroids(spark):
    got = centroids.cluster(frame(spark, ODD), dim=64)
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_partial_sums_equal_whole_ones():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (40, 64))
    c[7], x[3] = c[2], c[2]
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    at, far = centroids.nearest(x, c, rng.permutation(64))
    assert (at == d.argmin(1)).all() and (far == d.min(1)).all()
