"""Routing, lifecycle, settings and checks of pages on small fixtures."""

import posixpath
from urllib.parse import quote

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import lifecycle as Y
from corpusmill.operators import lineage as L
from corpusmill.operators import lint as Q
from corpusmill.operators import routing as I
from corpusmill.sources import records as E

GROUP = "group string, claim_id string, text string, knowledge_role string, page_intent_hints array<string>, section_path_parts array<string>, evidence_block_ids array<string>, ord int, line int, pos int, status string, lifecycle_status string, source_ids array<string>, source_refs array<string>"
EVIDENCE = "evidence_block_id string, block_kind string, metadata struct<key:string,value:string>, content_tags array<string>, semantic_features array<struct<tag:string,category:string,strength:string,evidence:string>>"


def claim(group, n, role="fact", hint="topic", section=("A",), evidence=(), status="draft"):
    return (group, f"{group}{n}", f"text {n}", role, [hint], list(section), list(evidence), 0, n, 0, status, "active", ["s"], ["r"])


def test_routes(spark):
    rows = [
        claim("a", 1, "reference", "reference", evidence=["e1"]), claim("b", 1, "procedure", "guide"), claim("c", 1, hint="timeline"), claim("d", 1, "meta", "reject"), claim("d", 2, hint="topic"), claim("e", 1, "meta", "reject"),
        claim("f", 1, section=["岗位职责"], evidence=["e2"]), claim("g", 1, hint="timeline"), claim("h", 1, hint="topic"),
    ]
    groups = spark.createDataFrame(rows, GROUP)
    evidence = spark.createDataFrame([("e1", "table_row", None, [], []), ("e2", "metadata_line", ("k", "v"), [], [])], EVIDENCE)
    context = I.structure_context(groups, evidence)
    worthy = spark.createDataFrame([("c",), ("h",)], "group string")
    decisions = spark.createDataFrame([("g", "d1", "Timeline", "strong_dates", [], []), ("b", "d2", "example", "weak", ["ambiguous_role"], [])], "group string, decision_id string, page_intent string, reason_code string, risk_flags array<string>, content_tags array<string>")
    got = {r.group: (r.page_intent, r.route_reason, r.confidence) for r in I.routed(I.signals(groups, context), worthy, decisions).collect()}
    assert got == {
        "a": ("reference", "heuristic_page_intent", 0.75), "b": ("topic", "page_intent_validation_downgraded_example_insufficient_group_evidence", 1.0), "c": ("concept", "heuristic_page_intent", 0.75), "d": ("topic", "heuristic_page_intent", 0.75),
        "e": ("reject", "heuristic_page_intent", 0.75), "f": ("duty", "heuristic_page_intent", 0.75), "g": ("timeline", "strong_dates", 1.0), "h": ("concept", "topic_promoted_to_concept_by_claim_group", 0.75),
    }
    tags = {r.group: r.semantic_feature_tags for r in I.frontmatter_tags(I.structure_projection(groups, context)).collect()}
    assert tags == {"a": ["reference_structure", "rules"], "f": ["metadata_fact"]}
    assert {r.group: r.ids for r in I.supporting_ids(groups, "evidence_block_ids", 24).collect()} == {"a": ["e1"], "f": ["e2"]}


def test_rendered_claims(spark):
    rows = [claim("a", 1), claim("a", 2, "meta", "reject", status="stable"), claim("a", 3, status="stable"), claim("b", 1, "meta", "reject"), claim("c", 1), claim("c", 2, "meta", "reject", status="stable")]
    assert sorted(r.claim_id for r in I.rendered_claims(spark.createDataFrame(rows, GROUP)).collect()) == ["a3", "b1", "c1"]


def test_consistency_and_risks(spark):
    pages = spark.createDataFrame([
        ("p1", "concept", "guide", "concept", "d1", ["d1"], ["c1", "c2"]), ("p2", "guide", "", "", "d9", ["d1"], ["c2"]), ("p3", "timeline", "", "", "", [], ["c1"]), ("p4", "concept", "", "", "", [], ["gone"]), ("p5", "overview", "x", "", "", [], ["c1"]),
    ], "page_id string, type string, page_intent string, route_target string, route_decision_id string, semantic_decision_ids array<string>, claim_ids array<string>")
    claims = spark.createDataFrame([("c1", "meta", ["reject"]), ("c2", "fact", ["topic"])], "claim_id string, knowledge_role string, page_intent_hints array<string>")
    got = {r.page_id: r.issues for r in Q.consistency_issues(pages, claims).collect()}
    assert got == {
        "p1": ["page_type_intent_mismatch:concept!=guide", "concept_page_blocked_roles:meta", "concept_page_reject_intent_hint"],
        "p2": ["page_route_decision_not_linked", "guide_page_missing_procedure_role:fact"], "p3": ["page_route_decision_missing", "timeline_page_semantically_thin:meta"],
    }
    live = spark.createDataFrame([("c1", "active", ["s"], ["r"], "draft", "", ["d0", "d1"]), ("c2", "active", ["s"], ["r"], "needs_review", "", ["d1"]), ("c3", "active", [], ["r"], "draft", None, ["d1"])], "claim_id string, lifecycle_status string, source_ids array<string>, source_refs array<string>, status string, review_reason string, semantic_decision_ids array<string>")
    decisions = spark.createDataFrame([("d0", "page_intent", ["ambiguous"]), ("d1", "claim_role", ["b_ambiguous", "plain", "a_ambiguous"])], "decision_id string, task_type string, risk_flags array<string>")
    assert [tuple(r) for r in Q.risky_claims(live, decisions).collect()] == [("c1", "a_ambiguous,b_ambiguous")]


def test_overviews(spark):
    link = "[x](../concepts/page_cpt_1.md)"
    body = "## 主题导览 / Theme Map\n- 先读这些基础主题：\n- {}\n\n## 推荐阅读路径 / Suggested Reading Path\n- none\n"
    schema = "page_id string, type string, title string, summary string, page_text string, claim_ids array<string>"
    rows = [("page_cpt_1", "concept", "vector index", "vector index of rows", "", []), ("o1", "overview", "", "", body.format("vector index of rows " + link), []), ("o2", "overview", "", "", body.format("about [x](../concepts/page_cpt_2.md)"), []), ("o3", "overview", "", "", "no guide", [])]
    got = {r.page_id: r.issue for r in Q.overview_issues(spark.createDataFrame(rows, schema)).collect()}
    assert got.pop("o1").startswith(("reading_path_missing_page_ref:", "theme_map_not_grounded:")) and got == {"o2": "theme_map_unknown_page_ref:page_cpt_2"}
    assert [tuple(r) for r in Q.overview_issues(spark.createDataFrame(rows[3:], schema)).collect()] == [("o3", "missing_concept_pages")]


def test_texts(spark):
    pairs = [("wiki/a/b.md", "wiki/c/d e.md"), ("a.md", "x/y.md"), ("wiki/a/b.md", "wiki/a/ü*(1)~.md"), ("a/b/c/d.md", "z.md")]
    got = [r.x for r in spark.createDataFrame(pairs, "a string, b string").select(T.relative_link("a", "b").alias("x")).collect()]
    assert got == [quote(posixpath.relpath(b, posixpath.dirname(a) or "."), safe="/._-~") for a, b in pairs]
    said = [("这个主题会介绍 vector index。", "vector index"), ("如果你刚开始，先读 vector index (claims=3, sources=2)", "vector index"), ("", ""), ("vector|index 主题", "vector index")]
    assert [r.x for r in spark.createDataFrame(said, "a string, b string").select(T.overview_statement("a").alias("x")).collect()] == [b for _, b in said]


def test_records(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "k string, v int"
    assert E.load_jsonl(spark, path, schema).count() == 0
    E.append_jsonl(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], schema), path)
    E.write_jsonl(E.replaced(E.load_jsonl(spark, path, schema), spark.createDataFrame([("b", 9), ("c", 4)], schema), "k"), path)
    assert sorted((r.k or "", r.v) for r in E.load_jsonl(spark, path, schema).collect()) == [("", 3), ("a", 1), ("b", 9), ("c", 4)]
    config = tmp_path / "project.yml"
    config.write_text("# c\nname: wiki\nsearch:\n  top: 5\n  fields:\n    - 'title'\n    - body\nempty:\n  deep:\n    x: a:b\n")
    assert {r.key: r.value for r in E.settings(spark, str(config)).collect()} == {"name": "wiki", "search.top": "5", "search.fields.0": "title", "search.fields.1": "body", "empty.deep.x": "a:b"}


def test_ledgers_and_links(spark):
    schema = "review_id string, created_at string, resolved_at string, candidate_claim_ids array<string>, candidate_page_ids array<string>, lifecycle_status string, archived_at string"
    rows = spark.createDataFrame([("r1", "2", None, ["c1"], ["p9"], "active", None), ("r2", "1", None, [], [], "active", None)], schema)
    old = spark.createDataFrame([("r1", "0", None, [], [], "superseded", None), ("r3", "1", "x", ["c"], [], "active", "t")], schema)
    assert [r.review_id for r in Y.review_ledger(rows, old).collect()] == ["r2", "r3", "r1"]
    pages = spark.createDataFrame([("p1", ["c1", "c1"]), ("p9", ["c1"]), ("p2", ["c7"])], "page_id string, claim_ids array<string>")
    got = {r.review_id: (r.candidate_page_ids, r.changed, r.lifecycle_status) for r in Y.linked_to_pages(rows, pages).collect()}
    assert got == {"r1": (["p9", "p1"], True, "active"), "r2": ([], False, "superseded")}
    sources = spark.createDataFrame([("generated",), ("failed",)], "status string")
    assert Y.pages_stay(sources, rows.limit(0)) and not Y.pages_stay(sources, rows) and not Y.pages_stay(sources.select(F.lit(None).cast("string").alias("status")))


def test_usage(spark):
    rows = [("r", "q1", "failed", False, 10, 5, True, 7, 1), ("r", "q1", "ok", True, None, 6, False, 9, 9), ("r", "q2", None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "run_id string, request_id string, status string, repaired boolean, backoff_ms long, duration_ms long, usage_available boolean, input_tokens long, output_tokens long")
    r = L.usage(frame).collect()[0].asDict()
    assert r == {"run_id": "r", "requests": 2, "attempts": 2, "failed": 1, "repaired": 1, "waited_ms": 10, "took_ms": 11, "with_usage": 1, "input_tokens": 7, "output_tokens": 1, "retries": 0, "without_usage": 1}
