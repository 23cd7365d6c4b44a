"""N-gram join, top-k search, embedding near-dedup: against brute force."""

import random
import re

import numpy as np
import pytest

from corpusmill.llm import embedding_dedup, ngram_join, textscan, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent, width):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("percent", "width", "at_once"), [(90, 3, 512), (90, 3, 3), (80, 5, 4)])
def test_ngram_join(spark, percent, width, at_once):
    rng = random.Random(percent + at_once)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for f in range(12):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 30, 120, 400]))
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + (" " + passage if f % 3 == 0 else "")))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, rows[0][1].upper())]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), percent, width, at_once)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, percent, width))


def test_ngram_edge_cases(docs, no_docs):
    got = ngram_join.similar_documents(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[3].n_shingles == 0 and by[4].component_id == 4 and by[7].n_shingles == 1
    assert ngram_join.similar_documents(no_docs).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_ngram_null_and_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    rows = frame([(None, a, "k"), (6, a + " x", "k"), (None, b, "k"), (None, b + " y", "k"), (5, a + " z", "k"), (5, "another text altogether", "k"), (8, a, "k"), (8, a, "k")])
    got = ngram_join.similar_documents(rows)
    assert sorted((r.component_id is None, r.component_id) for r in got.collect()) == [(False, 5)] * 6 + [(True, None)] * 2
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.one_of_each(rows).collect())
    assert [k for k in kept if k[0]] == [(5, a + " z"), (5, "another text altogether")] and len(kept) == 3
    # wordless rows stay; of equal rows one does
    rows = frame([(1, " ", "k"), (1, " ", "k"), (2, None, "k"), (3, a, "k"), (3, a, "k")])
    assert sorted(r.doc_id for r in ngram_join.one_of_each(rows).collect()) == [1, 1, 2, 3]


def test_large_groups_by_parts(spark, monkeypatch):
    """One large near-copy group and one passage that many documents share, with parts of 16 sets and tries of 8."""
    monkeypatch.setattr(ngram_join, "HELD", 16)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=60)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((2 * i, " ".join(w)))
        rows.append((2 * i + 1, " ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 20)))))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5, 8)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 80, 5))


def test_words_of_long_texts():
    """Stretches give the hashes that a whole text gives, but for words longer than a stretch."""
    words = [b"a" * n for n in (1, 5, 40, 3, 64, 7, 1, 63, 2)] * 3
    text = np.frombuffer(b"  " + b" ".join(words) + b" ", np.uint8)
    at = np.array([0, len(text)])
    whole, _ = textscan.word_hashes(text, at, textscan.LOWER)
    cut, first = textscan.word_hashes(text, at, textscan.LOWER, most=64)
    assert (whole == cut).all() and first[1] == 27
    short, _ = textscan.word_hashes(text, at, textscan.LOWER, most=50)
    assert [a == b for a, b in zip(whole, short)] == [len(w) <= 50 for w in words] and len(set(short.tolist())) == len(set(whole.tolist()))


def vectors(n=700, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:80] = x[50] + rng.normal(size=(30, d)) * 0.02
    x[100:110] = x[100]
    x[200] = x[201] * 3
    return [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [None] + [1.0] * (d - 1), 1)]


SCHEMA = "vec_id long, embedding array<double>, id int"


def test_top_k(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = topk_search.top_k(topk_search.build_index(frame), frame.where("vec_id % 50 = 0"), 10).collect()
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_edge_cases(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [1.0], 1), (4, [0.5, 0.5], 1), (None, [1.0, 1.0], 1)], SCHEMA)
    got = sorted(map(tuple, topk_search.top_k(topk_search.build_index(frame), frame.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 4, 1024 * 512)]
    assert topk_search.top_k(topk_search.build_index(frame.where("false")), frame.where("false")).count() == 0


def test_near_vectors(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in good if j != i and good[i] @ good[j] >= 0.95] for i in good}
    found = sum(got[i].n_links for i in good)
    assert len(got) == len(rows) and found >= 0.97 * sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in good)
    assert got[109].component_id == 100 and got[201].component_id == 200 and got[79].component_id == 50
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _, _ in rows[-4:])
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0
