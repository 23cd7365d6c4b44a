"""Text functions and identifiers against expected values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ids
from corpusmill.functions import text as T


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (T.normalize_document, "a  \r\nb\t\r\n\r\n", "a\nb\n"),
        (T.plain_text, "# H\n- **a** `b` [c](d)\n<!-- x -->", "H\na b c"),
        (T.normal_claim, "  The **Plan** works!  ", "the plan works"),
        (T.clean_claim, "> - 1. 因此 系统必须保留回链。", "系统必须保留回链"),
        (T.clean_claim, "3.5 percent", "5 percent"),
        (T.key, "topic-a/Note 01", "topic_a_note_01"),
        (T.section_label, "  ", T.NO_SECTION),
        (T.as_sentence, "abc", "abc。"),
        (T.first_sentence, "One two. Three.", "One two."),
        (T.inline_text, "**[a](b)** `c`", "a `c"),
        (T.question_topic, "什么是 回链？", "回链"),
        (T.family, "concept:a:b", "a:b"),
        (T.without_frontmatter, "---\na: 1\n---\nbody", "body"),
        (T.claim_reference, "- x [`clm_1`](y)", "clm_1"),
    ],
)
def test_strings(spark, function, given, wanted):
    assert value(spark, function(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("https://a.b/c", True), ("speaker: x", True), ("note that word: is a label", True), ("2024-01-02", True), ("---", True), ("ab", True), ("系统必须保留回链", False), ("claims are kept", False), ("a/b/c/d", True)],
)
def test_noise(spark, given, wanted):
    assert value(spark, T.noise(T.clean_claim(F.lit(given)))) is wanted


def test_candidates(spark):
    got = value(spark, T.claim_candidates(F.lit("# Title\n系统必须保留回链。审核不能跳过；它是必须的\nturn_id: 5")))
    assert got == ["系统必须保留回链", "审核不能跳过", "它是必须的"]
    long = "alpha beta gamma delta, " * 8
    got = value(spark, T.claim_candidates(F.lit(long)))
    assert got[0] == long.strip(" ,") and got[1:] == ["alpha beta gamma delta"]


def test_tokens(spark):
    got = value(spark, T.tokens(F.lit("ab c 回链表 x-yz ab")))
    assert got[:3] == ["ab", "yz", "ab"] and "回链" in got and "x-yz" in got and got.count("ab") == 2


def test_overlap(spark):
    o = value(spark, T.token_overlap(F.array(F.lit("abcd"), F.lit("xy")), F.array(F.lit("abcd"), F.lit("longerword"))))
    assert (round(o.overlap, 6), round(o.jaccard, 6), o.shared) == (round(2 / 3, 6), round(2 / 7, 6), 1)


def test_ids(spark):
    h = hashlib.sha256(b"x").hexdigest()
    assert value(spark, ids.source_id(F.lit("/w/raw/a/Note 1.md"), F.lit(h))) == f"src_a_note_1_{h[:12]}"
    assert value(spark, ids.concept_page_id(F.lit("b"))) == "page_cpt_" + hashlib.sha256(b"b").hexdigest()[:12]
    assert value(spark, T.truncate_bytes(F.lit("aé日"), 4)) == "aé"
    assert value(spark, ids.historical_id(F.lit(None).cast("string"), F.lit("c1"), F.lit("2024-01-02T03:04:05Z"))) == "c1__hist_20240102030405"
