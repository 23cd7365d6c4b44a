"""Quality classifier and language ID."""

import random

import numpy as np

from corpusmill.llm import language_id, quality


def corpus(spark, n=400):
    rng = random.Random(1)
    words = {"en": "the and of with that from this is on at by".split(), "de": "der die und nicht von mit sich auf für ist".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choices(words[lang], k=rng.randint(5, 60))) + "."
        good = rng.random() < 0.7
        rows.append((i, text if good else text.upper().replace(" ", "!! "), lang, "s", int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")


def test_quality_held_out(spark):
    rows = corpus(spark)
    model = quality.fit(rows, rows.select("doc_id", "quality").where(~quality.held_out()))
    got = quality.score(rows, model).join(rows, "doc_id").where(quality.held_out()).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == bool(r.quality) for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(rows, model).columns == rows.columns


def test_quality_equals_ridge_and_isotonic_of_all_rows_at_once(spark):
    """The model that partitions' sums give, against the same model fitted in one piece by other means."""
    rows = corpus(spark, 300)
    known = rows.select("doc_id", "quality").where(~quality.held_out())
    model = quality.fit(rows, known)
    texts = {r.doc_id: r.text.encode() for r in rows.collect()}
    y = {r.doc_id: r.quality for r in known.collect()}
    stats = np.concatenate([quality.statistics(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])])) for i in y])
    labels = np.array(list(y.values()), float)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.sd, stats.std(0) + 1e-6)
    z = model.features(stats)
    # ridge regression as least squares with one more row for each weight
    ridge = np.linalg.lstsq(np.vstack([z, 0.1 * np.eye(z.shape[1])]), np.concatenate([labels, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ model.ridge, z @ ridge, atol=1e-6)
    # isotonic values by the min-max formula over the same thousand bins
    at = np.clip(np.floor((z @ model.ridge + 0.5) * 500), 0, 999).astype(int)
    bins = np.unique(at)
    good, n = np.array([labels[at == b].sum() for b in bins]), np.array([(at == b).sum() for b in bins])
    want = [max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    assert np.allclose(np.interp((bins + 0.5) / 500 - 0.5, model.knots, model.values), want, atol=1e-9)


def test_quality_edge_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.score - 0.5) < 0.02 for r in quality.score(docs, quality.fit(docs, none)).collect())
    assert quality.keep_good(docs, quality.fit(docs, none)).count() == docs.count()
    one = spark.createDataFrame([(1, 1), (3, None), (77, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, one)).count() == docs.count()
    assert quality.score(no_docs, quality.fit(no_docs, none)).count() == 0


def test_isotonic_is_monotone_and_right():
    x, v = quality.isotonic(np.arange(6.0), np.array([0, 2, 1, 3, 0, 4.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert (np.diff(v) >= 0).all() and np.isclose(np.interp(5, x, v), 1)


def test_language_held_out(spark):
    rows = corpus(spark)
    got = language_id.predict(rows, language_id.learn(rows.where(~language_id.held_out()))).join(rows, "doc_id").where(language_id.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def naive_bits(learnt, text):
    """Prediction by partial matching, spelt out: escapes of method C with exclusion, frozen counts, contexts of three bytes down to none."""
    from collections import Counter, defaultdict

    follows = [defaultdict(Counter) for _ in range(4)]
    for t in learnt:
        padded = b"\n\n\n" + t.lower()
        for i in range(3, len(padded)):
            for k in range(4):
                follows[k][padded[i - k : i]][padded[i]] += 1

    def p(context, byte, k):
        if k < 0:
            return 1 / 256
        seen = follows[k].get(context[len(context) - k :])
        if not seen:
            return p(context, byte, k - 1)
        n, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + kinds)
        left = 1 - sum(p(context, b, k - 1) for b in seen)
        return kinds / (n + kinds) * p(context, byte, k - 1) / left

    padded = b"\n\n\n" + text.lower()
    return -sum(np.log2(p(padded[i - 3 : i], padded[i], 3)) for i in range(3, len(padded)))


def test_language_code_lengths_are_those_of_the_naive_model():
    learnt = [[b"abracadabra abra", b"a cat and a rat"], [b"Zebra zoo", b"", b"zz top \xc3\xa9"]]
    rows = []
    for k, texts in enumerate(learnt):
        buf, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        g, n = np.unique(language_id.windows(buf, at), return_counts=True)
        rows.append((np.full(len(g), k), g.astype(np.int64), n))
    trees = language_id.Trees(["x", "y"], *(np.concatenate(c) for c in zip(*rows)))
    texts = [b"abra cat", b"zzz", b"", b"new \x00\xff words, Zoo", b"e\xc3\xa9"]
    got = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, [[naive_bits(t, x) for t in learnt] for x in texts], rtol=1e-4)


def test_language_edge_cases(docs, no_docs):
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und"
    assert got[8].lang_pred == "de" and 0 <= got[8].score <= 1
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(no_docs)).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0
    assert language_id.keep_known(docs, model).columns == docs.columns
