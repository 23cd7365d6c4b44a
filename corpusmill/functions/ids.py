"""Identifiers: pure SHA-256 of UTF-8 text, so equal content has equal ids anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import key, normal_claim, sub


def digest(x: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def joined(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def raw_relative(path: Column) -> Column:
    """A source path from ``raw/`` on, without its suffix."""
    return sub(sub(sub(path, "^.*?raw/"), r"\.[^./]*$"), r"^[./]+")


def source_id(path: Column, content_hash: Column) -> Column:
    return F.concat(F.lit("src_"), key(raw_relative(path)), F.lit("_"), F.substring(content_hash, 1, 12))


def version_group(path: Column) -> Column:
    return F.concat(F.lit("vgrp_"), key(raw_relative(path)))


def structure_block_id(source: Column, start: Column, end: Column, text: Column) -> Column:
    raw = joined(source, start.cast("string"), end.cast("string"), text)
    return F.concat_ws("_", F.lit("sb"), source, start.cast("string"), end.cast("string"), digest(raw, 10))


def evidence_block_id(source: Column, structure_ids: Column, start: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit("ev"), source, start.cast("string"), digest(F.concat_ws("|", source, structure_ids, start.cast("string"), text), 12))


def knowledge_unit_id(source: Column, evidence_ids: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit("ku"), source, digest(F.concat_ws("|", source, evidence_ids, normal_claim(text)), 12))


def claim_id(source: Column, normal: Column) -> Column:
    return F.concat(F.lit("clm_"), digest(joined(source, normal), 16))


def concept_page_id(bucket: Column) -> Column:
    return F.concat(F.lit("page_cpt_"), digest(bucket, 12))


def intent_page_id(bucket: Column, intent: Column) -> Column:
    return F.concat(F.lit("page_"), F.substring(intent, 1, 3), F.lit("_"), digest(joined(intent, bucket), 12))


def source_page_id(source: Column) -> Column:
    return F.concat(F.lit("page_src_"), source)


def review_id(kind: Column, candidates: Column) -> Column:
    return F.concat(F.lit("rev_"), digest(F.concat_ws("|", F.array_sort(candidates), kind), 12))


def fingerprint(task: str, payload: Column, prompt_version: str = "v1", schema_version: str = "v1", route: str = "rules") -> Column:
    """The cache key of a semantic decision."""
    return digest(F.to_json(F.struct(payload.alias("items"), F.lit(prompt_version).alias("prompt"), F.lit(route).alias("route"), F.lit(schema_version).alias("schema"), F.lit(task).alias("task"))))


def decision_id(task: str, print_: Column) -> Column:
    return F.concat(F.lit(f"sem_{task}_"), F.substring(print_, 1, 16))


def signature(*columns: str) -> Column:
    """A change detector over columns."""
    return digest(F.to_json(F.struct(*columns)))


def historical_id(original: Column, id_: Column, archived_at: Column) -> Column:
    return F.concat(F.coalesce(original, id_), F.lit("__hist_"), F.substring(sub(archived_at, "[^0-9]"), 1, 20))


def alias_conflict_signature(alias: Column, canonical_ids: Column) -> Column:
    return F.concat(normal_claim(alias), F.lit("::"), F.concat_ws("|", F.array_sort(canonical_ids)))


def stem_hash_name(name: Column) -> Column:
    """A readable page file name; where cleaning changed it, six digits of its hash follow."""
    cleaned = F.btrim(sub(sub(name, r'[\\/:*?"<>|\n\r\t]+', " "), r"(?U)\s+", " "), F.lit(" ."))
    cleaned = F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("page"))
    return F.when(cleaned == name, name).otherwise(F.concat(cleaned, F.lit("_"), digest(name, 6)))
