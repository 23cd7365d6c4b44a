"""Stages against their operators."""

import re
from collections import Counter

import corpus_pipeline
from corpusmill.llm import language_id, mixing, quality

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").where(~quality.held_out())
    ids = lambda rows: sorted(r.doc_id for r in rows.collect())
    kept = corpus_pipeline.good_quality(spark, docs, D)
    assert ids(kept) == ids(quality.score(docs, quality.fit(docs, labels)).where(f"score >= {quality.THRESHOLD}"))
    known = corpus_pipeline.known_language(spark, docs, D)
    assert ids(known) == ids(language_id.predict(docs, language_id.learn(docs.where(~language_id.held_out()))).where("score >= 0.3"))
    # near duplicates, by comparing every two sets
    sets = {}
    for r in docs.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                least, most = sorted((group[a], group[b]))
                group = {i: least if g == most else g for i, g in group.items()}
    assert ids(corpus_pipeline.near_duplicates(spark, docs, D)) == sorted(i for i, g in group.items() if i == g)
    copies = {r.doc_id: r.copies for r in mixing.systematic_mix(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in corpus_pipeline.mixture(spark, docs, D).collect()) == Counter(copies)


def test_stages_on_odd_rows(spark, docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    odd = docs.selectExpr("*", "n AS row", "n AS copies", "n AS times", "key AS row_key", "n AS score")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, D)
        if k < 4:
            assert out.columns == odd.columns
        assert out.count() > 0 and stage(spark, odd.where("false"), D).count() == 0
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, D).collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9}


def test_pipeline_keeps_good_documents_and_columns(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing", "SentencePiece"]
    rows, counts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, d)
        rows.write.parquet(path := f"{tmp_path}/{i}")
        rows = spark.read.parquet(path)
        counts.append(rows.count())
        if i < 4:
            assert rows.columns == docs.columns
    labels = spark.read.parquet(f"{d}/labels.parquet").where(~quality.held_out())
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert len(good - kept) <= 0.02 * len(good)
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4] > counts[2]
