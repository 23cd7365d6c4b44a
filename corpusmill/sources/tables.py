"""Tables as sources: (source_id, source_path, source_type, ord, title, source_hash, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T


#: Tables of long texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer file splits than there are cores is dealt out to all, as its texts are worth more than the shuffle."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = name in TEXTS and rows.rdd.getNumPartitions() < cores
    return rows.repartition(cores) if few else rows


def as_sources(rows: DataFrame, path: Column, ord_: Column, title: Column, body: Column, kind: str, *more: Column) -> DataFrame:
    """Source rows of texts: ids follow path and content."""
    rows = rows.select(path.alias("source_path"), ord_.cast("long").alias("ord"), title.alias("title"), F.coalesce(body, F.lit("")).alias("raw"), *more)
    hash_ = ids.digest(F.col("raw"))
    return rows.select(ids.source_id(F.col("source_path"), hash_).alias("source_id"), "source_path", F.lit(kind).alias("source_type"), "ord", "title", hash_.alias("source_hash"), T.normalize_document("raw").alias("text"), *(c for c in rows.columns if c not in ("source_path", "ord", "title", "raw")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return as_sources(rows, F.format_string("raw/%s/doc_%d.txt", F.col("source"), F.col("doc_id")), F.col("doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("text"), "plain_text")


#: Rules from HTML to Markdown, in order: pattern and replacement.
HTML_RULES = (
    *((rf"(?is)<{tag}\b.*?</{tag}>", "") for tag in ("script", "style", "nav", "head")), (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<h{k}\b[^>]*>\s*(.*?)\s*</h{k}>", f"\n\n{'#' * k} $1\n\n") for k in range(1, 7)),
    (r"(?is)<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"), (r"(?is)<li\b[^>]*>\s*", "\n- "), (r"(?is)</t[dh]>\s*<t[dh]\b[^>]*>", " | "), (r"(?is)<tr\b[^>]*>\s*<t[dh]\b[^>]*>", "\n| "), (r"(?is)</t[dh]>\s*</tr>", " |\n"),
    (r"(?is)</?(?:p|div|ul|ol|table|tr|br|section|article)\b[^>]*>", "\n\n"), (r"(?s)<[^>]*>", ""),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"), (r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n"),
)


def html_to_markdown(x: Column) -> Column:
    """Headings, paragraphs, list items, table cells, links and line breaks as Markdown; other tags and scripts go."""
    for pattern, to in HTML_RULES:
        x = T.sub(x, pattern, to)
    return x


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    body = html_to_markdown(F.coalesce("html", F.lit("")))
    title = F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)<h1\b[^>]*>\s*(.*?)\s*</h1>", 1), F.lit("")), F.col("url"))
    return as_sources(rows, F.format_string("raw/pages/page_%d.md", F.col("page_id")), F.col("page_id"), title, body, "html", F.col("url"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per conversation; turns are paragraphs in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"])), "\n\n")
    return as_sources(rows, F.format_string("raw/chats/conv_%d.md", F.col("conv_id")), F.col("conv_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), body, "markdown")
