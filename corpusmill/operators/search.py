"""Full-text retrieval: fields, postings, statistics, weighted BM25 for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..sources.stages import staged

# Weights, boosts and markers of the ranking.
FIELD_WEIGHTS = {"title": 5.0, "aliases": 4.0, "hierarchy": 3.5, "summary": 3.0, "headings": 2.5, "claim_text": 2.0, "body": 1.0, "source_refs": 0.5}
TYPE_WEIGHTS = {"overview": 1.25, "concept": 1.22, "duty": 1.12, "topic": 1.08, "guide": 1.05, "reference": 1.04, "timeline": 1.02, "source-summary": 1.0, "example": 0.95, "draft": 0.70}
STATUS_WEIGHTS = {"stable": 1.10, "disputed": 0.90, "draft": 0.80, "needs_review": 0.75, "outdated": 0.60}
K1, B = 1.5, 0.75
TITLE_BOOST, CANONICAL_BOOST, ALIAS_BOOST, REGISTRY_BOOST = 1.35, 1.30, 1.25, 1.20
INTENT_MARKERS = {
    "how_to": ("how to", "tutorial"), "evidence": ("source", "evidence", "trace", "citation"), "reference": ("faq", "reference"), "overview": ("overview", "summary"),
    "definition": ("what is", "define", "definition"), "compare": ("vs", "versus", "compare", "difference"), "timeline": ("timeline", "history"),
}
INTENT_FIELDS = {
    "overview": {"title": 1.15, "summary": 1.20, "headings": 1.15, "body": 1.08, "claim_text": 1.05},
    "definition": {"title": 1.15, "summary": 1.15, "aliases": 1.10, "hierarchy": 1.08},
    "compare": {"claim_text": 1.15, "body": 1.10, "headings": 1.05, "hierarchy": 1.08},
    "timeline": {"body": 1.10, "summary": 1.05, "source_refs": 1.10},
    "reference": {"title": 1.10, "headings": 1.12, "body": 1.08, "claim_text": 1.06, "hierarchy": 1.10},
    "how_to": {"headings": 1.15, "body": 1.15, "claim_text": 1.10, "hierarchy": 1.12},
    "evidence": {"source_refs": 1.80, "claim_text": 1.20, "body": 1.05, "hierarchy": 1.08},
}
INTENT_TYPES = {
    "overview": {"overview": 1.85, "concept": 1.05, "duty": 1.08, "source-summary": 0.70}, "definition": {"concept": 1.7, "duty": 1.35}, "compare": {"concept": 1.12, "duty": 1.10},
    "reference": {"reference": 2.40, "duty": 1.20, "source-summary": 1.45, "concept": 0.35}, "how_to": {"source-summary": 1.05},
    "evidence": {"source-summary": 2.6, "topic": 0.55, "guide": 0.50, "duty": 0.70, "example": 0.50, "concept": 0.40},
}
DEPTHS = {"standard": (3, 2), "deep": (6, 5)}
#: Tokens of all queries together that are looked up in each text's tokens.
MOST_ASKED = 4096
# Fixed values of answers: what to read first by intent or page type, in what order, and what a status warns of.
FOCUS = {"overview": "workspace_overview", "compare": "compare_claims", "timeline": "timeline_evidence", "how_to": "procedural_chunks", "evidence": "source_evidence"}
TYPE_FOCUS = {"example": "worked_examples", "topic": "topic_orientation"}
STATUS_RISKS = {"needs_review": "page_needs_review", "disputed": "page_disputed", "outdated": "page_outdated", "draft": "page_draft"}
CITES = {"timeline": "strong", "evidence": "strong", "compare": "light", "how_to": "light"}
SUMMARY_INTENTS = ("lookup", "definition", "overview")
_FOCUS, _CLAIMS, _CHUNKS, _SUMMARY = "retrieval_context.focus", "evidence_context.matched_claims", "evidence_context.matched_chunks", "page_context.summary"
_TIMELINE, _TRAIL = "evidence_context.timeline_sources", "evidence_context.source_trail"
READ_ORDERS = {
    "timeline": ("sources_first", (_FOCUS, _CLAIMS, _CHUNKS, _TIMELINE, _SUMMARY)), "evidence": ("sources_first", (_FOCUS, _CLAIMS, _CHUNKS, _TRAIL, _SUMMARY)), "guide": ("chunks_first", (_FOCUS, _SUMMARY, _CHUNKS, _CLAIMS)),
    "example": ("claims_first", (_FOCUS, _SUMMARY, _CLAIMS, _CHUNKS)), "topic": ("summary_first", (_FOCUS, _SUMMARY, _CLAIMS, _CHUNKS)), "how_to": ("chunks_first", (_FOCUS, _CHUNKS, _CLAIMS, _SUMMARY)),
    "compare": ("claims_first", (_FOCUS, _CLAIMS, _CHUNKS, _SUMMARY)), "other": ("summary_first", (_SUMMARY, _CLAIMS, _FOCUS)),
}


def lookup(values: dict, key: Column, default: float | str | None) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def intent(query: Column) -> Column:
    """The first intent one of whose markers stands in the query, as a bare substring; else lookup."""
    text = F.concat(F.lower(query), F.lit(" "), T.normal_claim(query))
    out = F.lit("lookup")
    for name in reversed(INTENT_MARKERS):
        out = F.when(T.any_of(text, INTENT_MARKERS[name]), name).otherwise(out)
    return out


def queries_frame(spark, texts: list[str]) -> DataFrame:
    """(query_id, query, normal, tokens, intent)."""
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    return rows.select("query_id", "query", T.normal_claim("query").alias("normal"), T.tokens(T.normal_claim("query")).alias("tokens"), intent(F.col("query")).alias("intent"))


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, tokens) for the eight fields of page rows."""
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    texts = {
        "title": F.col("title"), "aliases": listed(F.col("aliases")), "hierarchy": listed(F.col("hierarchy")), "summary": F.col("summary"), "headings": listed(T.headings("page_text")),
        "claim_text": listed(F.col("claim_texts")), "body": T.searchable_body("page_text"), "source_refs": listed(F.col("source_paths")),
    }
    each = F.explode_outer(F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("text")) for k, v in texts.items()))).alias("x")
    return pages.select("page_id", each).select("page_id", "x.field", T.tokens(T.normal_claim("x.text")).alias("tokens"))


def postings(fields: DataFrame) -> DataFrame:
    """(page_id, field, token, tf, length)."""
    rows = fields.select("page_id", "field", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("token")).where("token IS NOT NULL")  # outer: texts are cut once, not for a filter too
    return rows.groupBy("page_id", "field", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "token").agg(F.count("*").alias("df"))


def text_frequency(pages: DataFrame) -> DataFrame:
    """(field, token, df) of whole pages. A row's tokens are made distinct in the row, so only counts by token are shuffled; rows that share a page id are counted by page."""
    twice = staged(pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("again")), "twice")
    each = lambda rows: page_fields(rows).select("field", F.explode_outer(F.array_distinct("tokens")).alias("token")).where("token IS NOT NULL")
    if twice.isEmpty():
        return document_frequency(each(pages))
    same = F.col("page_id").eqNullSafe(F.col("again"))
    return document_frequency(each(pages.join(twice, same, "left_anti")).unionByName(postings(page_fields(pages.join(twice, same, "left_semi"))).select("field", "token")))


def field_statistics(fields: DataFrame) -> DataFrame:
    """(field, pages, average): a row for each field; empty fields count."""
    return fields.groupBy("field").agg(F.count("*").alias("pages"), F.avg(F.size("tokens")).alias("average"))


def bm25(tf: Column, df: Column, pages: Column, length: Column, average: Column) -> Column:
    idf = F.log(F.lit(1.0) + (pages - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (length / F.greatest(average, F.lit(1e-9)))))


def field_hits(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """(page_id, field, length, hits): each field's number of tokens, and those of them that are asked for, repeats too.

    The one reading of the texts: what follows reads this narrow table. Queries that ask for more
    than MOST_ASKED tokens keep all tokens, and meet them by a join alone.
    """
    asked = [r.token for r in queries.select(F.explode("tokens").alias("token")).distinct().limit(MOST_ASKED + 1).collect()]
    hits = F.col("tokens") if len(asked) > MOST_ASKED else F.filter("tokens", lambda t: t.isin(asked))
    return staged(fields.select("page_id", "field", F.size("tokens").alias("length"), hits.alias("hits")), "hits")


def field_scores(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, page_id, field, score): BM25 per field; a token that a query repeats counts each time.

    Term frequencies are counted within a field's own row, so only asked tokens are ever shuffled.
    """
    hits = field_hits(queries, fields)
    statistics = hits.groupBy("field").agg(F.count("*").alias("pages"), F.avg("length").alias("average"))
    counted = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("token"), F.size(F.filter("hits", lambda h: h == t)).alias("tf")))
    posted = hits.where(F.size("hits") > 0).select("page_id", "field", "length", F.explode(counted).alias("x")).select("page_id", "field", "length", "x.token", "x.tf")
    asked = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    posted = posted.join(asked.select("token").distinct(), "token", "left_semi")
    found = posted.join(document_frequency(posted), ["field", "token"]).join(F.broadcast(statistics), "field")  # eight rows
    rows = found.join(asked, "token")
    each = F.col("times") * bm25(F.col("tf"), F.col("df"), F.col("pages"), F.col("length"), F.col("average"))
    return rows.groupBy("query_id", "page_id", "field").agg(F.sum(each).alias("score"), F.sort_array(F.collect_set("token")).alias("matched"))


def scored_pages(queries: DataFrame, pages: DataFrame, fields: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, title, type, status, score, matched_fields, reasons) of each page with a positive score.

    Score: the fields' BM25 by weight and intent, times the weights of type and status, the best
    exact-match boost, and the intent's boost of the type; rounded to 6 digits. ``registry``:
    (query_id, page_id) of pages whose aliases the query names.
    """
    fields = fields if fields is not None else page_fields(pages)
    scores = field_scores(queries, fields)
    by_intent = {f"{i}/{f}": w for i, fs in INTENT_FIELDS.items() for f, w in fs.items()}
    scores = scores.join(queries.select("query_id", "intent", "normal"), "query_id")
    factor = lookup(FIELD_WEIGHTS, F.col("field"), 0.0) * lookup(by_intent, F.concat_ws("/", "intent", "field"), 1.0)
    total = scores.groupBy("query_id", "page_id", "intent", "normal").agg(F.sum(F.col("score") * factor).alias("text_score"), F.sort_array(F.collect_set("field")).alias("matched_fields"))
    rows = total.join(pages.select("page_id", "title", "type", "status", "aliases", "canonical_id"), "page_id")
    if registry is not None:
        rows = rows.join(registry.select("query_id", "page_id").distinct().withColumn("named", F.lit(True)), ["query_id", "page_id"], "left")
    else:
        rows = rows.withColumn("named", F.lit(False))
    asked = F.col("normal") != ""
    exact = [
        ("title_exact", TITLE_BOOST, asked & (T.normal_claim("title") == F.col("normal"))), ("canonical_exact", CANONICAL_BOOST, asked & (T.normal_claim(F.coalesce("canonical_id", F.lit(""))) == F.col("normal"))),
        ("alias_exact", ALIAS_BOOST, asked & F.array_contains(F.transform("aliases", lambda a: T.normal_claim(a)), F.col("normal"))), ("alias_registry_hit", REGISTRY_BOOST, F.coalesce("named", F.lit(False))),
    ]
    boost = F.greatest(F.lit(1.0), *(F.when(F.coalesce(ok, F.lit(False)), w).otherwise(1.0) for _, w, ok in exact))
    reasons = F.array_compact(F.array(*(F.when(ok, name) for name, _, ok in exact)))
    by_type = {f"{i}/{t}": w for i, ts in INTENT_TYPES.items() for t, w in ts.items()}
    kind = F.when((F.col("intent") == "timeline") & (F.col("status") == "stable"), 1.05).otherwise(lookup(by_type, F.concat_ws("/", "intent", "type"), 1.0))
    score = F.round(F.col("text_score") * lookup(TYPE_WEIGHTS, F.col("type"), 0.70) * lookup(STATUS_WEIGHTS, F.col("status"), 0.80) * boost * kind, 6)
    return rows.select("query_id", "page_id", "title", "type", "status", "intent", score.alias("score"), "matched_fields", reasons.alias("reasons")).where("score > 0")


def top_pages(scored: DataFrame, limit: int = 5) -> DataFrame:
    """The best pages of each query; ties by title, descending, then page id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("title"), "page_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def matched_tokens(query_tokens: Column, tokens: Column, limit: int = 8) -> Column:
    return F.slice(F.array_intersect(query_tokens, tokens), 1, limit)


def reading_pack(top: DataFrame, queries: DataFrame, page_claims: DataFrame, page_chunks: DataFrame, depth: str = "standard") -> DataFrame:
    """For each result its best claims and chunks and the trail of their sources.

    ``page_claims``: (page_id, claim_id, text, source_ids); ``page_chunks``: (page_id, chunk_id,
    source_id, text, section_path, start_line). Claims score by matched tokens, chunks by matched
    tokens of text plus .45 of section's, .2 for any of these and .25 for texts of up to 600
    characters. It runs on the results alone, after the ranking.
    """
    n_claims, n_chunks = DEPTHS[depth]
    base = top.join(queries.select("query_id", "tokens"), "query_id").select("query_id", "page_id", "rank", F.col("tokens").alias("asked"))
    best = lambda rows, score, tie, n: rows.withColumn("s", score).where("s > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(F.desc("s"), tie))).where(F.col("r") <= n)
    c = base.join(page_claims, "page_id")
    c = best(c, F.size(matched_tokens(F.col("asked"), T.tokens(T.normal_claim("text")))), "claim_id", n_claims)
    claims = c.groupBy("query_id", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"))
    k = base.join(page_chunks, "page_id")
    hit = F.size(matched_tokens(F.col("asked"), T.tokens(T.normal_claim("text"))))
    section = F.size(matched_tokens(F.col("asked"), T.tokens(T.normal_claim("section_path"))))
    some = (hit + section) > 0
    k = best(k, F.when(some, hit + 0.45 * section + F.when(section > 0, 0.2).otherwise(0.0) + F.when(F.length("text") <= 600, 0.25).otherwise(0.0)).otherwise(0.0), "chunk_id", n_chunks)
    chunks = k.groupBy("query_id", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    trail = c.select("query_id", "page_id", F.explode("source_ids").alias("source_id")).unionByName(k.select("query_id", "page_id", "source_id")).groupBy("query_id", "page_id").agg(F.sort_array(F.collect_set("source_id")).alias("source_trail"))
    out = top
    for more in (claims, chunks, trail):
        out = out.join(more, ["query_id", "page_id"], "left")
    none = F.array().cast("array<string>")
    return guardrails(out.withColumns({x: F.coalesce(x, none) for x in ("claim_ids", "chunk_ids", "source_trail")}))


def guardrails(results: DataFrame) -> DataFrame:
    """What an answer must mind, and how it is handed over: risk flags, what must be read, in what order, how strongly to cite.

    ``review_ids`` of results are the open reviews of their pages; without the column there are none.
    A page's source trail is its sources in time where the intent is timeline.
    """
    intent_, kind, status = F.col("intent"), F.col("type"), F.col("status")
    reviewed = F.size("review_ids") > 0 if "review_ids" in results.columns else F.lit(False)
    no_claims, no_chunks, no_trail = F.size("claim_ids") == 0, F.size("chunk_ids") == 0, F.size("source_trail") == 0
    risks = F.array_compact(F.array(
        F.when(reviewed, "has_open_reviews"), lookup(STATUS_RISKS, status, None), F.when(no_claims, "no_matched_claims"), F.when(intent_.isin("how_to", "timeline", "evidence") & no_chunks, "no_matched_chunks"),
        F.when((intent_ == "timeline") & no_trail, "no_timeline_sources"), F.when((intent_ == "evidence") & no_trail, "weak_source_trace"),
    ))
    summary_only = intent_.isin(*SUMMARY_INTENTS) & ~kind.isin("guide", "example") & ~status.isin("needs_review", "disputed", "outdated") & ~reviewed
    read_claims, read_chunks, read_sources = (intent_.isin(*names) for names in (("compare", "timeline", "evidence"), ("how_to", "timeline", "evidence"), ("timeline", "evidence")))
    route = (
        F.when(intent_.isin("timeline", "evidence"), intent_).when(kind.isin("guide", "example"), kind).when((kind == "topic") & intent_.isin(*SUMMARY_INTENTS), "topic")
        .when(intent_.isin("how_to", "compare"), intent_).otherwise("other")
    )
    order = F.create_map(*(x for k, (_, paths) in READ_ORDERS.items() for x in (F.lit(k), F.array(*map(F.lit, paths)))))[route]
    required = F.array_compact(F.array(F.when(read_claims, _CLAIMS), F.when(read_chunks, _CHUNKS), F.when(intent_ == "timeline", _TIMELINE).when(intent_ == "evidence", _TRAIL)))
    focus = F.when((intent_ == "how_to") & (kind == "guide"), "guide_steps").otherwise(F.coalesce(lookup(FOCUS, intent_, None), lookup(TYPE_FOCUS, kind, "general_lookup")))
    cite = lookup(CITES, intent_, "none")
    fallback = F.when(F.size(risks) > 0, "answer_with_uncertainty").when(summary_only, "answer_from_summary_and_claims").otherwise("read_required_evidence_before_answering")
    return results.withColumns({
        "risk_flags": risks, "can_answer_from_summary_only": summary_only, "must_read_claims": read_claims, "must_read_chunks": read_chunks, "must_read_sources": read_sources, "cite_expectation": cite,
        "answer_mode": lookup({k: mode for k, (mode, _) in READ_ORDERS.items()}, route, None), "read_order": order, "required_evidence": required, "reading_focus": focus,
        "should_cite_sources": cite != "none", "should_surface_uncertainty": F.size(risks) > 0, "fallback_action": fallback,
    })


def hierarchy_match(asked: Column, path: Column) -> Column:
    """Struct (leaf_hits, parent_hits, anchor) of asked tokens in a section path: anchored at the leaf, a parent, both, or nowhere."""
    hits = lambda text: F.size(matched_tokens(asked, T.tokens(T.normal_claim(text))))
    parts = F.split(path, " > ")
    leaf, parent = hits(F.element_at(parts, -1)), hits(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    anchor = F.when((leaf > 0) & (parent > 0), "leaf_and_parent").when(leaf > 0, "leaf").when(parent > 0, "parent").otherwise("none")
    return F.struct(leaf.alias("leaf_hits"), parent.alias("parent_hits"), anchor.alias("anchor"))


def answers(packs: DataFrame) -> DataFrame:
    """One row per query: the selected page, alternatives 2 to 4, and whether the match is weak (no fields, or a score under 1 without evidence)."""
    first = packs.where("rank = 1")
    others = packs.where("rank BETWEEN 2 AND 4").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"]).alias("alternatives"))
    weak = (F.size("matched_fields") == 0) | ((F.col("score") < 1) & (F.size("claim_ids") == 0) & (F.size("chunk_ids") == 0))
    return first.join(others, "query_id", "left").withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>"))).withColumn("weak_match", weak)


def answer_prompt(answer: DataFrame) -> DataFrame:
    """Answers with a prompt and its ChatML form as text columns."""
    lines = F.concat_ws("\n", F.concat(F.lit("Page: "), "title", F.lit(" ("), "page_id", F.lit(")")), F.concat(F.lit("Mode: "), "answer_mode"), F.concat(F.lit("Claims: "), F.array_join("claim_ids", ", ")), F.concat(F.lit("Chunks: "), F.array_join("chunk_ids", ", ")), F.concat(F.lit("Risks: "), F.array_join("risk_flags", ", ")))
    return answer.withColumn("prompt", lines).withColumn("chatml", F.concat(F.lit("<|im_start|>user\n"), "prompt", F.lit("<|im_end|>\n<|im_start|>assistant\n")))


def index_records(pages: DataFrame, version: str = "pages_v1") -> DataFrame:
    """Search-index rows with the signature by which a refresh reuses them."""
    fields = page_fields(pages)
    packed = fields.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "tokens"))).alias("field_tokens"))
    return pages.withColumn("page_signature", ids.signature("title", "type", "status", "page_text")).withColumn("index_version", F.lit(version)).join(packed, "page_id")


def refresh_index(pages: DataFrame, previous: DataFrame, version: str = "pages_v1") -> DataFrame:
    """Rows whose page signature and version still hold are reused, all others built."""
    signed = pages.withColumn("page_signature", ids.signature("title", "type", "status", "page_text"))
    keys = ["page_id", "page_signature"]
    good = previous.where(F.col("index_version") == version)
    kept = good.join(signed.select(*keys), keys, "left_semi")
    fresh = index_records(pages.join(kept.select("page_id"), "page_id", "left_anti"), version)
    return kept.unionByName(fresh)
