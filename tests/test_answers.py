"""Guardrails and handoff, page links, lineage, question headings, single claims worth a page."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import concepts as K
from corpusmill.operators import graph as G
from corpusmill.operators import lineage as L
from corpusmill.operators import search as X


def test_guardrails_and_handoff(spark):
    rows = [("a", "timeline", "concept", "draft", [], [], [], []), ("b", "lookup", "topic", "stable", [], ["c"], [], ["s"]), ("c", "how_to", "guide", "stable", ["r"], ["c"], ["k"], ["s"]), ("d", "evidence", "reference", "disputed", [], ["c"], ["k"], []), ("e", "compare", "concept", "stable", [], ["c"], [], ["s"])]
    frame = spark.createDataFrame(rows, "page_id string, intent string, type string, status string, review_ids array<string>, claim_ids array<string>, chunk_ids array<string>, source_trail array<string>")
    got = {r.page_id: r for r in X.guardrails(frame).collect()}
    assert got["a"].risk_flags == ["page_draft", "no_matched_claims", "no_matched_chunks", "no_timeline_sources"]
    assert (got["a"].answer_mode, got["a"].reading_focus, got["a"].cite_expectation, got["a"].fallback_action) == ("sources_first", "timeline_evidence", "strong", "answer_with_uncertainty")
    assert got["a"].required_evidence == ["evidence_context.matched_claims", "evidence_context.matched_chunks", "evidence_context.timeline_sources"]
    assert got["b"].risk_flags == [] and got["b"].can_answer_from_summary_only and got["b"].fallback_action == "answer_from_summary_and_claims" and got["b"].reading_focus == "topic_orientation"
    assert got["c"].risk_flags == ["has_open_reviews"] and got["c"].answer_mode == "chunks_first" and got["c"].reading_focus == "guide_steps" and not got["c"].can_answer_from_summary_only
    assert got["d"].risk_flags == ["page_disputed", "weak_source_trace"] and got["d"].read_order[3] == "evidence_context.source_trail"
    assert got["e"].answer_mode == "claims_first" and got["e"].cite_expectation == "light" and got["e"].fallback_action == "read_required_evidence_before_answering"


def test_hierarchy_match(spark):
    rows = spark.createDataFrame([(["setup", "linux"], "install guide > linux setup"), (["guide"], "install guide > windows"), (["mac"], "a > b")], "asked array<string>, path string")
    assert [r.m.anchor for r in rows.select(X.hierarchy_match(F.col("asked"), F.col("path")).alias("m")).collect()] == ["leaf", "parent", "none"]


def test_page_links(spark):
    rows = [("p1", "wiki/a/one.md", "[x](../b/two%20x.md#top) [y](https://h/wiki/b/two x.md) [z](#here) [s](/wiki/c.md)"), ("p2", "wiki/b/two x.md", "[u](../../wiki/./a/one.md) [self](two x.md) [none](gone.md)"), ("p3", "wiki/c.md", "")]
    pages = spark.createDataFrame(rows, "page_id string, page_path string, page_text string")
    assert sorted(map(tuple, G.page_links(pages).collect())) == [("p1", "p2"), ("p1", "p3"), ("p2", "p1")]


def test_descendants_of_any_depth(spark):
    steps = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(9)] + [("t", "s2"), ("s2", "t")]
    got = {r.step_id: r.depth for r in L.descendants(spark.createDataFrame(steps, "step_id string, parent_id string"), "s1").collect()}
    assert got == {f"s{i}": i - 1 for i in range(1, 9)} | {"t": 2}


def test_question_headings(spark):
    rows = ["运营 是什么 运营是日常工作", "什么是 运营 运营是日常工作", "运营 指什么 别的内容", "plain text"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(T.heading_body(F.col("x"))).collect()]
    assert got == ["运营是日常工作", "运营是日常工作", rows[2], rows[3]]


def test_single_claims_worth_a_page(spark):
    rows = [("date", "", "2024-05-01", "fact"), ("definition", "", "A page: what a reader sees at once", "definition"), ("topic", "Billing rules", "Invoices go out monthly", "fact"), ("plain", "", "Invoices go out monthly and on time", "fact"), ("marker", "Billing rules", "仅生成占位", "fact")]
    frame = spark.createDataFrame([(g, t, x, k, 1, [g]) for g, t, x, k in rows], "group string, topic string, text string, claim_type string, rank int, source_ids array<string>")
    got = {r.group for r in K.worth_a_page(frame, K.title(frame)).collect()}
    assert got == {"date", "definition", "topic"}
