"""Texts of plain prose take shorter ways through the text rules; what comes out is what the rules say."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import structure as S

PARTS = [
    "word", "Été", "straße", "Ünder", "useful", "a", "b", "İx", "слово", "回链", "12", "3.", "x/y", "key", ": ", ":", "：", " ", "  ", " ", " ", ", ", ",", ",,", ". ", ".", ".  ", "! ", "!", "?", "; ", ";", "-", " - ", "- ", "--", "+ ", "* ", "**", "# ",
    "## ", "> ", "`", "```", "_", "__", "~~", "[a](b)", "](", "(", ")", "[", "<!--", "-->", "\n", "\n", "\n\n", "\n- ", "\n-\n", "\n- 1.\n", "\n- \n", "\n1.\n", "\n##\n", "\n\n\n\n", "\t", " ", "　", "\u0085", "。", "；", "因此", "什么是 ", "|", "$", "%", "'", '"', "speaker:", "2024-01-02", "raw/", "{", "}",
    " alpha beta gamma delta epsilon, zeta eta theta iota kappa, lambda mu nu xi omicron, pi rho sigma tau ypsilon, phi chi psi omega and all the rest of it",
]


def texts(n, seed):
    rng = random.Random(seed)
    calm = [p for p in PARTS if not set(p) & set("#*+`~<>_[:/|\t") and not any(c.isdigit() for c in p)]
    return ["".join(rng.choice(PARTS if i % 3 == 0 else calm[: 8 + 40 * (i % 2)]) for _ in range(rng.randint(0, 14))) for i in range(n)]


def outcome(rows):
    got = rows.select(
        "i", T.plain_text("x").alias("plain"), T.normal_claim("x").alias("normal"), T.clean_claim("x").alias("clean"), T.noise(T.clean_claim("x")).alias("noise"), T.claim_type("x").alias("type"),
        T.claim_candidates("x").alias("candidates"), T.text_claims("x").alias("claims"), T.metadata("x").alias("metadata"),
    )
    return {r.i: r for r in got.collect()}


def test_prose_comes_out_as_by_the_rules(spark, monkeypatch):
    x = [*texts(1500, 3), "", None, "a\nb", "Aaaa bbb, cccc! Dddd - eee;ffff.", "ab! cd!", "- abcd", "abcd\n\nefgh, ijkl"]
    rows = spark.createDataFrame(list(enumerate(x)), "i int, x string").repartition(4).localCheckpoint()
    proses = rows.where(T.prose(F.col("x"))).count()
    short = outcome(rows)
    monkeypatch.setattr(T, "prose", lambda v: F.lit(False))
    monkeypatch.setattr(T, "by_line", lambda v: F.lit(False))
    by_rules = outcome(rows)
    assert [(x[i], short[i], r) for i, r in by_rules.items() if short[i] != r] == []
    colons = rows.select("i", T._metadata(F.col("x")).alias("m")).collect()
    assert {r.i: r.m for r in colons} == {i: r.metadata for i, r in short.items()}
    old = {r.i: r.f for r in rows.select("i", T.claim_candidates(T.plain_text(T.without_fences("x"))).alias("f")).collect()}
    assert {i: r.claims for i, r in by_rules.items()} == old
    assert 100 < proses < 1400


def test_prose_is_not_cut_by_the_long_rules(spark):
    """A document of many lines of prose is cut line by line: none of its lines needs the rules."""
    text = "Alpha beta gamma, delta.\nÉté é useful. Omega psi\n"
    rows = spark.createDataFrame([("s", "p", 1, text)], "source_id string, source_path string, ord long, text string")
    assert S.lines(rows).select(T.prose(F.col("s")).alias("p")).where("NOT p").count() == 0
    assert rows.select(T.by_line(F.col("text")).alias("b")).first().b
    assert rows.select(T.text_claims("text").alias("c")).first().c == ["Alpha beta gamma, delta", "Été é useful. Omega psi"]
