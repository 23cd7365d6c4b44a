"""What records are: live, archived, superseded, current; and the ledgers that hold them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T

# States of sources.
CLAIMED = ("claimed", "review_required", "generated")
SETTLED = ("generated", "failed")


def _empty(column: str) -> Column:
    return F.coalesce(F.size(F.col(column)), F.lit(0)) <= 0


def claim_status() -> Column:
    """superseded if it says so, archived with a date, superseded without sources or references, else active."""
    return F.when(F.col("lifecycle_status") == "superseded", "superseded").when(F.col("archived_at").isNotNull(), "archived").when(_empty("source_ids") | _empty("source_refs"), "superseded").otherwise("active")


def review_status() -> Column:
    """As for claims, by candidates instead of sources."""
    return F.when(F.col("lifecycle_status") == "superseded", "superseded").when(F.col("archived_at").isNotNull(), "archived").when(_empty("candidate_claim_ids") & _empty("candidate_page_ids"), "superseded").otherwise("active")


def page_status() -> Column:
    return F.when(F.coalesce("removed", F.lit(False)), "removed").when(F.col("archived_at").isNotNull(), "archived").otherwise("active")


def is_live_page() -> Column:
    """Neither removed nor archived; a missing state counts as live."""
    return ~F.coalesce(F.col("lifecycle_status").isin("removed", "archived"), F.lit(False)) & ~F.coalesce("removed", F.lit(False))


def live_pages(pages: DataFrame) -> DataFrame:
    return pages.where(is_live_page())


def claims_extracted(status: Column) -> Column:
    """Whether a source has been through claim extraction."""
    return F.coalesce(status.isin(*CLAIMED), F.lit(False))


def pages_stay(sources: DataFrame, *changes: DataFrame) -> bool:
    """Whether no page needs making again: nothing changed, and every source is generated or failed. Reads one row of each."""
    return all(rows.isEmpty() for rows in changes) and sources.where(~F.coalesce(F.col("status").isin(*SETTLED), F.lit(False))).isEmpty()


def is_current(version: str, converter: str, converter_version: str) -> Column:
    """Whether a normalized record need not be made again: its version is this one's, and so is its converter's, if one made it."""
    own = F.coalesce(F.startswith("extraction_method", F.lit(converter)), F.lit(False))
    return F.coalesce(F.col("normalizer_version") == version, F.lit(False)) & (~own | F.coalesce(F.col("converter_version") == converter_version, F.lit(False)))


def claim_ledger(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live and historical claims by time of making, of change, and id; missing times come first."""
    rows = live.unionByName(history, allowMissingColumns=True)
    return rows.orderBy(F.coalesce("created_at", F.lit("")), F.coalesce("updated_at", F.lit("")), "claim_id")


def review_ledger(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live reviews and those historical ones that aren't live, by time of making, of resolving, and id."""
    rows = live.unionByName(history.join(live.select("review_id"), "review_id", "left_anti"), allowMissingColumns=True)
    return rows.orderBy(F.coalesce("created_at", F.lit("")), F.coalesce("resolved_at", F.lit("")), "review_id")


def linked_to_pages(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """Reviews whose candidates gain the pages that show any of their claims, new ones behind the known in order of id; ``changed`` marks them."""
    shown = pages.select("page_id", F.explode("claim_ids").alias("claim_id"))
    found = reviews.select("review_id", F.explode("candidate_claim_ids").alias("claim_id")).join(shown, "claim_id").select("review_id", "page_id").distinct()
    found = found.groupBy("review_id").agg(F.sort_array(F.collect_set("page_id")).alias("found"))
    none = F.array().cast("array<string>")
    rows = reviews.join(found, "review_id", "left").withColumn("known", F.coalesce("candidate_page_ids", none))
    rows = rows.withColumn("fresh", F.array_except(F.coalesce("found", none), "known")).withColumn("candidate_page_ids", F.concat("known", "fresh"))
    return rows.withColumn("changed", F.size("fresh") > 0).withColumn("lifecycle_status", review_status()).drop("found", "known", "fresh")


def structured_sources(*ledgers: DataFrame) -> DataFrame:
    """(source_id) of sources in every one of the ledgers: blocks, evidence and units."""
    return reduce(lambda a, b: a.join(b, "source_id", "left_semi"), (rows.select("source_id").distinct() for rows in ledgers))


def source_pages_of_claims(claims: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, page_id, title): source summaries that show the claims of a key, each once, by title without case."""
    rows = claims.select(key, F.explode("page_ids").alias("page_id")).distinct().join(pages.where("type = 'source-summary'").select("page_id", "title"), "page_id")
    return rows.select(key, "page_id", "title").orderBy(key, F.lower(F.coalesce("title", F.lit(""))), "page_id")


def live_page(pages: DataFrame, canonical_id: str, type_: str) -> DataFrame:
    """At most one live page of a canonical id and type, the least id."""
    return live_pages(pages).where((F.col("canonical_id") == canonical_id) & (F.col("type") == type_)).orderBy("page_id").limit(1)


def missing_concepts(worthy: DataFrame, pages: DataFrame) -> DataFrame:
    """(group) of groups that are worth a page and have none."""
    return worthy.select("group").distinct().withColumn("page_id", ids.concept_page_id(F.col("group"))).join(pages.select("page_id"), "page_id", "left_anti").select("group")


def with_alias_action(pages: DataFrame, action: DataFrame) -> DataFrame:
    """Override rows (page_id, aliases) after actions (page_id, alias, assign): the alias goes from each candidate page, and to the one that it is assigned to; others stay as they are."""
    named = action.groupBy("page_id").agg(F.collect_set(T.normal_claim("alias")).alias("gone"), F.collect_set(F.when(F.col("assign"), F.col("alias"))).alias("given"))
    kept = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: ~F.array_contains("gone", T.normal_claim(a)))
    return pages.select("page_id", "aliases").join(named, "page_id").select("page_id", F.sort_array(F.array_union(kept, F.col("given"))).alias("aliases"))
