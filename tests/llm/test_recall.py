"""Recall of the embedding near-dedup beside large groups, and graphs without lost vertices."""

import numpy as np

from corpusmill.llm import embedding_dedup as E


def test_nothing_is_lost():
    x = np.random.default_rng(1).normal(size=(6000, 8))
    g = E.Graph(x / np.linalg.norm(x, axis=1, keepdims=True), [np.full((6000, E.GROUND + E.SPARE), -1, np.int32)])
    g._reach_all()
    seen, front = {0}, [0]
    while front:
        front = [v for v in {int(w) for u in front for w in g.links[0][u] if w >= 0} if v not in seen]
        seen.update(front)
    assert len(seen) == 6000


def test_joined_pairs_keep_components():
    rng = np.random.default_rng(2)
    names, ids = np.arange(1000, 1060), np.arange(0, 400, 2)
    i, j = rng.integers(0, 60, 90), rng.integers(0, 200, 90)
    a, b = E.joined(i, j, names, ids)

    def classes(pairs):
        to = {}

        def find(v):
            while to.setdefault(v, v) != v:
                v = to[v]
            return v

        for x, y in pairs:
            to[max(find(x), find(y))] = min(find(x), find(y))
        return {v: find(v) for v in to}

    want = classes(zip(names[i].tolist(), ids[j].tolist()))
    got = classes(zip(a.tolist(), b.tolist()))
    assert got == want and len(a) <= 60 + 200


def test_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(7)
    d = 32
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    group = unit(rng.normal(size=d) + rng.normal(size=(400, d)) * 0.02)
    one, turn = unit(rng.normal(size=(400, d))), rng.normal(size=(400, d))
    turn = unit(turn - (turn * one).sum(1, keepdims=True) * one)
    x = np.concatenate([group, one, 0.955 * one + np.sqrt(1 - 0.955**2) * turn])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_vectors(rows, first_beam=1).collect()}
    assert np.mean([got[800 + i].component_id == 400 + i for i in range(400)]) >= 0.98
    assert all(got[i].n_links == 399 for i in range(400))
