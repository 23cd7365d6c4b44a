"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chosen_rows, cut, prefix_sums, row_key, word_count

#: Expected copies are counted in these parts of one copy, so sums are exact.
PARTS = 1 << 24


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of sources (source_key, source_size): weights repeat in key order, the total is
    ``share`` of all sizes, and no target exceeds ``cap`` times its source's size.

    Resharing the excess by weight until no source is above its cap ends where target =
    min(cap, level * weight): with sources in ascending order of cap / weight, the level is the
    first one that doesn't reach the next source's cap. One row per source.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("source_key")
    k = (F.row_number().over(ordered) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (k + 1).cast("int"))
    limits = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(cap))
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "source_key")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = limits.select(
        "*", (F.sum("source_size").over(whole) * float(share)).alias("budget"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"),
        F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "source_key", "level"))).over(whole)["level"]
    target = F.least(F.col("limit"), F.coalesce(reached * F.col("weight"), F.col("limit")))
    return level.select("source_key", "source_size", target.alias("target"))


def systematic_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """How often each document enters the mix: (id, size, source_size, target, copies, taken, text_crc32, source_key, row).

    Each document of a source expects target / source_size copies. Documents stand in order of
    (words, id, text checksum, ``row``) within their source, which spreads the sample evenly over sizes;
    the expected copies before a document, plus one offset per source drawn from ``seed``, give
    its copies: one for each whole number crossed. Copies never exceed ``cap``, rounded up. All sums are integers, so
    reruns agree. Null texts have size 0, null sources are a source of their own (last); repeated
    rows count each; an empty table gives no rows; sources without words have target 0.
    """
    source = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    sized = docs.select(F.col(id_col), word_count(text_col).alias("size"), source.alias("source_key"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32"), (F.lit(0) if row is None else row).cast("long").alias("row"))
    sized = sized.withColumnRenamed(id_col, "id")
    rows = prefix_sums(sized, ["source_key"], ["size", "id", "text_crc32", "row"], ["size"])
    targets = source_targets(rows.groupBy("source_key").agg(F.max("all_size").alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("source_key")).cast("binary")), 1, 6), 16, 10).cast("long")
    each = F.coalesce(F.floor(F.col("target") * PARTS / F.col("source_size") + 0.5), F.lit(0)).cast("long")
    targets = targets.withColumn("_each", F.when(F.col("source_size") > 0, each).otherwise(0)).withColumn("_offset", offset)
    out = rows.join(targets, "source_key").withColumn("_start", F.col("index") * F.col("_each") + F.col("_offset"))
    out = out.withColumn("copies", F.expr(f"(_start + _each) div {PARTS} - _start div {PARTS}"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_crc32", "source_key", "row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row, with all its columns, as often as systematic_mix says.

    Rows that repeat an id or a text but differ in any column are rows of their own; rows that are
    equal in all columns come as often as all of them together should. Columns of any names pass
    through. Rows without words are drawn like others; an empty table gives no rows.
    """
    found = systematic_mix(docs, row=row_key(docs), **options)
    rows = cut(found.groupBy("row").agg(F.sum("copies").alias("copies"), F.count("*").alias("times")).where("copies > 0"), "copies")
    taken, copies = chosen_rows(docs, rows, "copies")
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")


_WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))::BIGINT"


def mix_sql(docs: str = "documents", seed: str = "mix") -> str:
    """DuckDB SQL for the same rows, with the columns of op2 and source_key."""
    return f"""
WITH sized AS (
  SELECT doc_id, {_WORDS.format('text')} AS size, text,
         CASE WHEN source IS NULL THEN 'n' ELSE '=' || source END AS source_key FROM {docs}),
idx AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY size, doc_id) - 1 AS i FROM sized),
src AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY encode(source_key)) - 1) % 3] AS weight,
             source_size * 2.0::DOUBLE AS lim FROM src),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
             coalesce(sum(lim) OVER (ORDER BY lim / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
             sum(weight) OVER (ORDER BY lim / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT *, (budget - full_) / open_weight AS level FROM f),
t AS (SELECT source_key, source_size, least(lim, coalesce(
        (SELECT arg_min(level, (lim / weight, source_key)) FROM l WHERE level * weight <= lim) * weight, lim)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * {PARTS} / source_size + 0.5)::BIGINT ELSE 0 END AS each,
             ('0x' || substr(md5('{seed}' || source_key), 1, 6))::BIGINT AS off FROM t),
c AS (SELECT doc_id, size, source_size, target, source_key,
             (i * each + off + each) // {PARTS} - (i * each + off) // {PARTS} AS copies FROM idx JOIN e USING (source_key))
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM c"""
