"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums


def balanced_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Contiguous shards of near equal bytes: (id, size, text_crc32, shard, slot).

    A row's size is its text's UTF-8 bytes plus ``overhead``. Rows stand in ascending id order
    (null ids first; rows of one id by checksum and size); the shard is the equal target that
    holds the row's first byte, so a shard is at most one row off its target and every shard is
    one run of ids. A row larger than a target leaves the targets it covers empty. ``slot``
    counts from 0 in each shard, without gaps. Null texts are empty; repeated rows each take a
    slot of their own; an empty table gives no rows; other columns are not read.
    """
    sized = docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = prefix_sums(sized, [], [id_col, "text_crc32", "size"], ["size"])
    shard = F.least(F.expr(f"(before_size * {n_shards}) div greatest(all_size, 1)"), F.lit(n_shards - 1)).cast("int")
    rows = rows.withColumn("shard", shard)
    first = rows.groupBy("shard").agg(F.min("index").alias("first"))  # n_shards rows
    return rows.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
