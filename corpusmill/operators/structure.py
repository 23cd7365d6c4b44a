"""From texts to evidence: structure blocks, evidence blocks, knowledge units, sections, chunks.

All sequence logic is windows over the lines of a source; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..sources.stages import staged

#: Chunk sizes in characters, at four to an estimated token.
TARGET, MOST, LEAST = 4000, 6400, 800


def by_line():
    return Window.partitionBy("source_id").orderBy("line_no")


def so_far():
    return by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def lines(sources: DataFrame) -> DataFrame:
    """(source_id, source_path, ord, line_no, line, s): lines from 1, and each stripped."""
    each = F.posexplode_outer(F.split(T.sub("text", r"\n\z"), "\n", -1)).alias("_pos", "line")  # outer: an inner one would have Spark split texts again for a filter
    return sources.select("source_id", "source_path", "ord", each).where("_pos IS NOT NULL").select("source_id", "source_path", "ord", (F.col("_pos") + 1).alias("line_no"), "line", T.strip("line").alias("s"))


def line_type(s: Column) -> Column:
    """What a stripped line is: blank, heading, code_block, blockquote, list_item, table_separator, table_row or paragraph."""
    table = F.contains(s, F.lit("|")) & s.rlike(r"^\|?.+\|.+\|?$")
    return (
        F.when(s == "", "blank").when(s.rlike(r"(?U)^#{1,6}\s+\S"), "heading").when(F.startswith(s, F.lit("```")), "code_block").when(s.rlike(r"(?U)^>\s+"), "blockquote")
        .when(s.rlike(r"(?U)^(?:[-*+]|\d+[.)])\s+"), "list_item").when(table & s.rlike(r"(?U)^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"), "table_separator").when(table, "table_row").otherwise("paragraph")
    )


def _attributes(kind: Column, line: Column, s: Column) -> Column:
    """A block's attributes as a map of strings."""
    marker = F.regexp_extract(s, r"^([-*+])", 1)
    indent = (F.length(line) - F.length(F.ltrim(line))).cast("string")
    return (
        F.when(kind == "heading", F.create_map(F.lit("heading_level"), F.length(F.regexp_extract(s, r"^(#+)", 1)).cast("string"), F.lit("heading_text"), T.inline_text(T.sub(s, r"(?U)^#{1,6}\s+"))))
        .when(kind == "list_item", F.create_map(F.lit("list_marker"), F.coalesce(F.nullif(marker, F.lit("")), F.lit("ordered")), F.lit("list_indent"), indent))
        .when(kind == "code_block", F.create_map(F.lit("fence"), F.lit("```")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def _stack(level: Column, title: Column, line_no: Column) -> Column:
    """The heading stack at each line as an array of (line, title): the last heading of each level that no heading of a higher level has closed."""
    out, closed = [], F.lit(0)
    for k in range(1, 7):
        last = F.last(F.when(level == k, F.struct(line_no.alias("at"), title.alias("title"))), ignorenulls=True).over(so_far())
        out.append(F.when(last["at"] > closed, last))
        closed = F.greatest(closed, F.coalesce(last["at"], F.lit(0)))
    return F.array_compact(F.array(*out))


def bare_blocks(sources: DataFrame) -> DataFrame:
    """One row per block without its neighbours and parent: (…, parent_line). Blocks lie as their sources' lines do, so what goes on by source needs no further shuffle.

    Fences toggle code; an unclosed one makes a paragraph of what follows. Headings, list items,
    quotes and table rows are blocks of one line, paragraphs runs of other lines. A block's path
    is the heading stack (a heading pops all of its level or deeper), its parent the innermost
    heading, a heading's parent the one above it.
    """
    rows = lines(sources).withColumn("fence", F.startswith("s", F.lit("```")).cast("int"))
    rows = rows.withColumn("fences", F.coalesce(F.sum("fence").over(before()), F.lit(0))).withColumn("all_fences", F.sum("fence").over(Window.partitionBy("source_id")))
    code = (F.col("fences") % 2 == 1) | (F.col("fence") == 1)
    open_end = (F.col("all_fences") % 2 == 1) & (F.col("fences") + F.col("fence") == F.col("all_fences")) & code & ~((F.col("fence") == 1) & (F.col("fences") % 2 == 1))
    rows = rows.withColumn("code", code).withColumn("kind", F.when(open_end, "paragraph").when(code, "code_block").otherwise(line_type(F.col("s"))))
    run = (F.col("kind") == "paragraph") & ~F.col("code")
    fresh = F.when(F.col("code"), (F.col("fence") == 1) & (F.col("fences") % 2 == 0)).when(run, ~F.coalesce(F.lag(run).over(by_line()), F.lit(False))).otherwise(F.col("kind") != "blank")
    rows = rows.withColumn("block", F.sum(fresh.cast("int")).over(so_far()))
    heading = F.col("kind") == "heading"
    level = F.when(heading, F.length(F.regexp_extract("s", r"^(#+)", 1)))
    title = T.section_label(T.inline_text(T.sub("s", r"(?U)^#{1,6}\s+")))
    rows = rows.withColumn("stack", _stack(level, title, F.col("line_no"))).where((F.col("kind") != "blank") | F.col("code"))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    blocks = rows.groupBy("source_id", "block").agg(
        first("source_path"), first("ord"), first("kind"), first("line"), first("s"), first("stack"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"),
    )
    raw = T.sub("raw", r"(?U)\s+\z")
    return blocks.select(
        ids.structure_block_id(F.col("source_id"), F.col("start_line"), F.col("end_line"), raw).alias("structure_block_id"), "source_id", "source_path", "ord", F.col("kind").alias("block_type"),
        T.strip(raw).alias("text"), raw.alias("raw_markdown"), F.transform("stack", lambda x: x["title"]).alias("heading_path_parts"),
        F.try_element_at(F.transform("stack", lambda x: x["at"]), F.when(F.col("kind") == "heading", -2).otherwise(-1)).alias("parent_line"),
        "start_line", "end_line", _attributes(F.col("kind"), F.col("line"), F.col("s")).alias("attributes"), ids.digest(raw).alias("hash"),
    )


def structure_blocks(sources: DataFrame) -> DataFrame:
    """``bare_blocks`` with the ids of those before, behind and above them."""
    blocks, order = bare_blocks(sources), Window.partitionBy("source_id").orderBy("start_line")
    blocks = blocks.withColumns({"previous_block_id": F.lag("structure_block_id").over(order), "next_block_id": F.lead("structure_block_id").over(order)})
    heads = blocks.where("block_type = 'heading'").select("source_id", F.col("start_line").alias("parent_line"), F.col("structure_block_id").alias("parent_block_id"))
    return blocks.join(heads, ["source_id", "parent_line"], "left").drop("parent_line")


def with_children(blocks: DataFrame) -> DataFrame:
    """Blocks with the ids of the headings right below them."""
    below = blocks.where("block_type = 'heading' AND parent_block_id IS NOT NULL").groupBy(F.col("parent_block_id").alias("structure_block_id"))
    below = below.agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "structure_block_id"))), lambda x: x["structure_block_id"]).alias("children_block_ids"))
    return blocks.join(below, "structure_block_id", "left").withColumn("children_block_ids", F.coalesce("children_block_ids", F.array().cast("array<string>")))


def features(kind: Column, cells: Column, has_metadata: Column) -> Column:
    """Structural feature tags of evidence."""
    tag = lambda name, strength, why: F.struct(F.lit(name).alias("tag"), F.lit("structure").alias("category"), F.lit(strength).alias("strength"), F.lit(why).cast("string").alias("evidence") if isinstance(why, str) else why.alias("evidence"))
    full = F.size(F.filter(F.coalesce(cells, F.array().cast("array<string>")), lambda c: T.strip(c) != "")) >= 2
    listed = kind.isin("table_row", "metadata_line")
    return F.array_compact(F.array(
        F.when(listed, tag("rules", "strong", kind)), F.when(listed, tag("reference_structure", "strong", kind)), F.when(kind == "code_example", tag("cases", "strong", kind)),
        F.when(kind == "code_example", tag("example_structure", "strong", kind)), F.when(kind == "list_item_with_body", tag("local_heading_body", "medium", kind)),
        F.when(full, tag("reference_structure", "strong", "table_cells")), F.when(has_metadata, tag("metadata_fact", "strong", "metadata_keys")),
    ))


def content_tags(features_: Column) -> Column:
    """Tags of features that aren't structural: none today."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(features_, lambda f: f["category"] != "structure"), lambda f: f["tag"])))


def evidence_blocks(blocks: DataFrame) -> DataFrame:
    """One row per evidence block: a list item takes the paragraph right behind it in its section along; table separators go."""
    order = Window.partitionBy("source_id").orderBy("start_line")
    nxt = {c: F.lead(c).over(order).alias(f"n_{c}") for c in ("block_type", "text", "heading_path_parts", "structure_block_id", "end_line")}
    rows = blocks.select("*", *nxt.values())
    takes = (F.col("block_type") == "list_item") & (F.col("n_block_type") == "paragraph") & (F.col("n_heading_path_parts") == F.col("heading_path_parts"))
    rows = rows.withColumn("takes", F.coalesce(takes, F.lit(False)))
    rows = rows.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False))).where("NOT taken AND block_type <> 'table_separator'")
    kind, text = F.col("block_type"), F.col("text")
    meta = F.when(kind == "paragraph", T.metadata("text"))
    rows = rows.withColumn("meta", meta)
    evidence = (
        F.when(kind == "heading", "section_heading").when(F.col("takes"), "list_item_with_body").when(kind == "code_block", "code_example").when((kind == "paragraph") & F.col("meta").isNotNull(), "metadata_line").otherwise(kind)
    )
    local = F.when(kind == "heading", T.inline_text(T.strip(T.sub("text", "^#+")))).when(kind == "list_item", T.list_text("text"))
    rows = rows.select(
        "source_id", "source_path", "ord", evidence.alias("block_kind"), local.alias("local_heading"), F.when(F.col("takes"), F.concat(local, F.lit("\n"), T.strip("n_text"))).when(kind == "list_item", local).otherwise(text).alias("text"),
        F.when(F.col("takes"), F.array("structure_block_id", "n_structure_block_id")).otherwise(F.array("structure_block_id")).alias("structure_block_ids"), F.col("heading_path_parts").alias("section_path_parts"),
        "start_line", F.when(F.col("takes"), F.col("n_end_line")).otherwise(F.col("end_line")).alias("end_line"), F.col("meta").alias("metadata"), F.when(kind == "table_row", T.table_cells("raw_markdown")).alias("cells"), "attributes",
    )
    tags = features(F.col("block_kind"), F.col("cells"), F.col("metadata").isNotNull() | (F.size("attributes") > 0) | (F.col("block_kind") == "section_heading"))
    rows = rows.withColumn("semantic_features", tags).withColumn("content_tags", content_tags(F.col("semantic_features")))
    hints = {"section_heading": "heading_as_structure_context", "list_item_with_body": "local_heading_attached_to_body", "list_item": "list_item_as_evidence", "table_row": "table_row_as_evidence", "code_example": "code_block_preserved_as_evidence", "metadata_line": "metadata_extracted_from_paragraph", "paragraph": "paragraph_as_evidence"}
    hint = F.coalesce(F.create_map(*(F.lit(x) for kv in hints.items() for x in kv))[F.col("block_kind")], F.lit("single_structure_block"))
    return rows.select(ids.evidence_block_id(F.col("source_id"), F.col("structure_block_ids"), F.col("start_line"), F.col("text")).alias("evidence_block_id"), *rows.columns, hint.alias("extraction_hint"), ids.digest(F.col("text")).alias("hash"))


def unit_kind(evidence_kind: Column) -> Column:
    return F.when(evidence_kind == "metadata_line", "metadata_fact").when(evidence_kind == "table_row", "table_fact").when(evidence_kind == "section_heading", "structural_shell").when(evidence_kind == "code_example", "code_example").otherwise("statement")


def knowledge_units(evidence: DataFrame) -> DataFrame:
    """One unit per evidence block with text."""
    kind = unit_kind(F.col("block_kind"))
    return evidence.where(T.strip("text") != "").select(
        ids.knowledge_unit_id(F.col("source_id"), F.array("evidence_block_id"), F.col("text")).alias("knowledge_unit_id"), "source_id", "source_path", "ord", "text", T.normal_claim("text").alias("normalized_text"), kind.alias("unit_kind"), "local_heading", "metadata", "cells", "section_path_parts",
        F.array("evidence_block_id").alias("evidence_block_ids"), "start_line", "end_line", F.col("extraction_hint").alias("extraction_reason"), F.when(kind == "structural_shell", "structural_shell").otherwise("standalone").alias("quality_label"), F.lit("draft").alias("status"), F.lit("active").alias("lifecycle_status"), "semantic_features", "content_tags",
        *(c for c in ("facts",) if c in evidence.columns),
    )


def compile_structure(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, evidence and units, all staged, as everything after them reads them."""
    blocks = staged(structure_blocks(sources), "blocks")
    evidence = staged(evidence_blocks(blocks), "evidence")
    return blocks, evidence, staged(knowledge_units(evidence), "units")


def sections(sources: DataFrame) -> DataFrame:
    """Lines with their section by ATX headings, code fences not regarded: (…, section, parts).

    A heading replaces the part of the path at its level's place, or at the next free one.
    """
    rows = lines(sources)
    head = F.col("line").rlike(r"(?U)^#{1,6}\s+\S")
    rows = rows.withColumn("level", F.when(head, F.length(F.regexp_extract("line", r"^(#+)", 1)))).withColumn("section", F.count("level").over(so_far()))
    depth = F.col("section") + F.least(F.lit(0), F.min(F.col("level") - F.col("section")).over(so_far()))
    rows = rows.withColumn("depth", F.when(F.col("section") > 0, depth))
    title = T.section_label(T.sub("line", r"(?U)^#{1,6}\s+"))
    parts = [F.last(F.when(F.col("level").isNotNull() & (F.col("depth") == k), title), ignorenulls=True).over(so_far()) for k in range(1, 7)]
    rows = rows.withColumn("_parts", F.array(*parts))
    return rows.withColumn("parts", F.when(F.col("section") == 0, F.array(F.lit(T.PREAMBLE))).otherwise(F.slice("_parts", 1, F.greatest(F.col("depth"), F.lit(1)).cast("int")))).drop("_parts", "level", "depth")


def paragraph_sections(sources: DataFrame) -> DataFrame:
    """Lines with their section by blank lines; headings stand alone; the label is the first 24 characters."""
    rows = lines(sources).withColumn("head", F.col("line").rlike(r"(?U)^#{1,6}\s+\S"))
    text = (F.col("s") != "") & ~F.col("head")
    fresh = F.col("head") | (text & ~F.coalesce(F.lag(text).over(by_line()), F.lit(False)))
    rows = rows.withColumn("section", F.sum(fresh.cast("int")).over(so_far())).where("s <> ''")
    label = T.section_label(F.when(F.col("head"), T.sub("line", r"(?U)^#{1,6}\s+")).otherwise(F.substring("s", 1, 24)))
    first = Window.partitionBy("source_id", "section").orderBy("line_no")
    return rows.withColumn("parts", F.array(F.first(label).over(first))).drop("head")


def section_blocks(sectioned: DataFrame) -> DataFrame:
    """Blank-line blocks of each section; fences keep their blank lines."""
    w = Window.partitionBy("source_id", "section").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sectioned.withColumn("inside", F.sum(F.startswith("s", F.lit("```")).cast("int")).over(upto) % 2 == 1).withColumn("gap", (F.col("s") == "") & ~F.col("inside"))
    rows = rows.withColumn("block", F.sum(F.col("gap").cast("int")).over(upto)).where("NOT gap")
    text = T.sub(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), r"^\n+|\n+\z")
    out = rows.groupBy("source_id", "section", "block").agg(F.first("source_path").alias("source_path"), F.first("ord").alias("ord"), F.first("parts").alias("parts"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), text.alias("text"))
    return out.where(T.strip("text") != "")


def _groups(blocks: Column) -> Column:
    """The group of each block, packed greedily in order: a group ends before it would pass MOST or once it reaches TARGET; a last group under LEAST joins the one before."""
    start = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("g"), F.lit(0).alias("chars"), F.lit(0).alias("n"))

    def step(acc: Column, b: Column) -> Column:
        over = (acc["n"] > 0) & (acc["chars"] + b["chars"] > MOST)
        g = F.when(over, acc["g"] + 1).otherwise(acc["g"])
        chars = F.when(over, b["chars"]).otherwise(acc["chars"] + b["chars"])
        full = ~over & (chars >= TARGET)
        return F.struct(F.concat(acc["of"], F.array(g)).alias("of"), F.when(full, g + 1).otherwise(g).alias("g"), F.when(full, 0).otherwise(chars).alias("chars"), F.when(full, 0).when(over, 1).otherwise(acc["n"] + 1).alias("n"))

    def finish(acc: Column) -> Column:
        small = (acc["n"] > 0) & (acc["g"] > 0) & (acc["chars"] + 2 * (acc["n"] - 1) < LEAST)
        return F.transform(acc["of"], lambda g: F.when(small & (g == acc["g"]), g - 1).otherwise(g))

    return F.aggregate(blocks, start, step, finish)


def chunks(sources: DataFrame, strategy: str = "heading_first", document_kind: str = "note") -> DataFrame:
    """Chunks of a source in order, numbered from 0, with their neighbours, staged; ``strategy`` heading_first, paragraph_first or chat_turn."""
    sectioned = sections(sources) if strategy == "heading_first" else paragraph_sections(sources)
    blocks = section_blocks(sectioned).withColumn("chars", F.length("text"))
    lists = blocks.groupBy("source_id", "section").agg(F.first("source_path").alias("source_path"), F.first("ord").alias("ord"), F.first("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("start_line", "end_line", "chars", "text"))).alias("blocks"))
    each = lists.select("source_id", "source_path", "ord", "section", "parts", F.explode(F.arrays_zip("blocks", _groups(F.col("blocks")).alias("g"))).alias("x"))
    rows = each.select("source_id", "source_path", "ord", "section", "parts", F.col("x.g").alias("g"), "x.blocks.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda x: x["text"]), "\n\n")
    rows = rows.groupBy("source_id", "section", "g").agg(F.first("source_path").alias("source_path"), F.first("ord").alias("ord"), F.first("parts").alias("parts"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.concat(T.strip(text), F.lit("\n")).alias("text"))
    path = F.array_join("parts", " > ")
    rows = rows.withColumn("section_path", path).withColumn("hash", ids.digest(F.col("text")))
    rows = rows.withColumn("chunk_id", F.concat_ws("_", F.lit("chk"), "source_id", T.key("section_path"), F.col("start_line").cast("string"), F.substring("hash", 1, 10)))
    order = Window.partitionBy("source_id").orderBy("section", "g")
    h = T.section_hierarchy(F.col("parts"))
    rows = rows.select(
        "chunk_id", "source_id", "source_path", "ord", "section_path", h["parts"].alias("section_path_parts"), h["title"].alias("section_title"), h["parent"].alias("parent_section_path"), h["level"].alias("heading_level"), (F.row_number().over(order) - 1).alias("chunk_index"),
        "start_line", "end_line", F.length("text").alias("char_count"), T.estimated_tokens("text").alias("token_estimate"), T.summary("text").alias("summary"), "text", F.lag("chunk_id").over(order).alias("previous_chunk"), F.lead("chunk_id").over(order).alias("next_chunk"), "hash", F.lit(strategy).alias("chunk_kind"), F.lit(document_kind).alias("topicworthiness_hint"),
    )
    return staged(rows, "chunks")
