"""Reviews and what follows from them: actions, automatic plans, promotion, retraction, history.

Actions work on whole frames of decided reviews at once; ``review_loop`` applies reviews that
depend on each other in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..sources.stages import staged


def none() -> Column:
    return F.array().cast("array<string>")


def live_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where("lifecycle_status = 'active' AND size(candidate_claim_ids) > 0")


def actionable(reviews: DataFrame) -> DataFrame:
    return live_reviews(reviews).where("status = 'open'")


def listed(reviews: DataFrame, status: str | None = None) -> DataFrame:
    rows = reviews if status is None else reviews.where(F.col("status") == status)
    return rows.orderBy("created_at", "review_id")


def for_claims(reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """Open reviews that touch any of the claims."""
    touched = actionable(reviews).select("review_id", F.explode("candidate_claim_ids").alias("claim_id")).join(claims.select("claim_id"), "claim_id", "left_semi")
    return reviews.join(touched.select("review_id").distinct(), "review_id", "left_semi")


def plans(reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """(review_id, kind, action, primary_claim_id, others): what is safe to do with an open review.

    A duplicate of exactly two live claims merges into the one with more sources, the longer clean
    text, the later id; a conflict where one side has at least two sources more archives the other,
    else both stay; everything else waits for a person.
    """
    rows = actionable(reviews).select("review_id", "kind", F.size("candidate_claim_ids").alias("n"), F.explode("candidate_claim_ids").alias("claim_id"))
    rows = rows.join(claims.select("claim_id", F.size("source_ids").alias("sources"), F.length(T.clean_claim("text")).alias("size")), "claim_id")
    rank = F.struct("sources", "size", "claim_id")
    g = rows.groupBy("review_id", "kind", "n").agg(F.count("*").alias("live"), F.max(rank).alias("best"), F.min("sources").alias("least"), F.sort_array(F.collect_set("claim_id")).alias("all"))
    pair = (F.col("live") == 2) & (F.col("n") == 2)
    action = F.when(pair & (F.col("kind") == "claim_duplicate"), "merge").when(pair & (F.col("kind") == "claim_conflict"), F.when(F.col("best.sources") >= F.col("least") + 2, "archive_one").otherwise("keep_both")).otherwise("wait")
    return g.select("review_id", "kind", action.alias("action"), F.col("best.claim_id").alias("primary_claim_id"), F.array_except("all", F.array("best.claim_id")).alias("others"))


def _moves(decided: DataFrame) -> DataFrame:
    """(claim_id, action, to): each loser's first decision by review_id; ``to``: the claim at the end of its chain of merges, null if archived."""
    first = Window.partitionBy("claim_id").orderBy("review_id")
    each = decided.where(F.col("action").isin("merge", "archive_one")).select("review_id", "action", F.when(F.col("action") == "merge", F.col("primary_claim_id")).alias("to"), F.explode("others").alias("claim_id"))
    moves = staged(each.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("claim_id", "action", "to"), "moves")
    for _ in range(40):  # chains halve each time
        on = moves.where("action = 'merge'").select(F.col("claim_id").alias("to"), F.col("to").alias("beyond"))
        if moves.join(on, "to", "left_semi").isEmpty():
            break
        moves = staged(moves.join(on, "to", "left").select("claim_id", "action", F.coalesce("beyond", "to").alias("to")), "moves")
    return moves


def merged(claims: DataFrame, decided: DataFrame) -> DataFrame:
    """Claims after merges and archivings: losers end superseded or archived, primaries take the losers' sources and references.

    Of a claim that several reviews decide, the first review's decision holds; chains of merges go to their end.
    """
    acts = _moves(decided).withColumnRenamed("to", "primary_claim_id")
    gains = acts.where("action = 'merge'").join(claims.select("claim_id", F.col("source_ids").alias("s"), F.col("source_refs").alias("r")), "claim_id")
    gains = gains.groupBy(F.col("primary_claim_id").alias("claim_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("gain_s"), F.flatten(F.collect_list("r")).alias("gain_r"))
    rows = claims.join(gains, "claim_id", "left").join(acts.select("claim_id", "action", F.col("primary_claim_id").alias("into")), "claim_id", "left")
    life = F.when(F.col("action") == "merge", "superseded").when(F.col("action") == "archive_one", "archived").otherwise(F.col("lifecycle_status"))
    return rows.withColumns({"source_ids": F.when(F.col("gain_s").isNotNull(), F.array_union("source_ids", "gain_s")).otherwise(F.col("source_ids")), "source_refs": F.when(F.col("gain_r").isNotNull(), F.array_union("source_refs", "gain_r")).otherwise(F.col("source_refs")), "lifecycle_status": life, "superseded_by": F.when(F.col("action") == "merge", F.array("into")).otherwise(none())}).drop("gain_s", "gain_r", "action", "into")


def rewritten(reviews: DataFrame, decided: DataFrame) -> DataFrame:
    """Open reviews after those decisions: losers replaced by their primaries or dropped; under two candidates left, or decided itself: resolved."""
    moves = _moves(decided).select("claim_id", "to")
    each = reviews.select("review_id", F.posexplode("candidate_claim_ids").alias("pos", "claim_id")).join(moves.withColumn("moved", F.lit(True)), "claim_id", "left")
    new = each.withColumn("now", F.when(F.col("moved"), F.col("to")).otherwise(F.col("claim_id"))).where("now IS NOT NULL")
    new = new.groupBy("review_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "now"))), lambda x: x["now"])).alias("now"))
    done = decided.where("action <> 'wait'").select("review_id", F.lit(True).alias("done"))
    rows = reviews.join(new, "review_id", "left").join(done, "review_id", "left")
    now = F.coalesce("now", none())
    closed = F.coalesce("done", F.lit(False)) | (F.size(now) < 2)
    return rows.withColumns({"candidate_claim_ids": now, "status": F.when((F.col("status") == "open") & closed, "resolved").otherwise(F.col("status"))}).drop("now", "done")


def review_flags(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims with status needs_review while an open review names them, and draft again when none does."""
    named = actionable(reviews).select(F.explode("candidate_claim_ids").alias("claim_id")).distinct().withColumn("named", F.lit(True))
    rows = claims.join(named, "claim_id", "left")
    status = F.when(F.col("named") & (F.col("status") == "draft"), "needs_review").when(F.col("named").isNull() & (F.col("status") == "needs_review"), "draft").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("named")


def promotion_gate() -> Column:
    """Why a draft is not promoted, null if it is: the gates in order."""
    text = T.clean_claim("text")
    return (
        F.when(F.col("lifecycle_status") != "active", "not_live").when(F.col("status") != "draft", "not_draft").when(F.size("source_ids") == 0, "no_source").when(F.size("source_refs") == 0, "no_reference").when(F.col("under_review"), "open_review")
        .when(text == "", "empty").when(T.noise(text), "noise").when(T.short_gray_zone("text"), "short").when(T.strip("text").rlike("[？?]$"), "question").when(F.length(text) > 240, "long").when(F.size("source_ids") < 2, "single_source")
    )


def promoted(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Safe drafts become stable; ``gate`` says why others don't."""
    named = actionable(reviews).select(F.explode("candidate_claim_ids").alias("claim_id")).distinct().withColumn("under_review", F.lit(True))
    rows = claims.join(named, "claim_id", "left").withColumn("under_review", F.coalesce("under_review", F.lit(False)))
    rows = rows.withColumn("gate", promotion_gate())
    return rows.withColumn("status", F.when(F.col("gate").isNull(), "stable").otherwise(F.col("status"))).drop("under_review")


def set_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims with the statuses of (claim_id, new_status) laid over."""
    return claims.join(changes, "claim_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def retract_sources(claims: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, historical): claims without the sources of ``gone`` (source_id); a claim without references left goes to history.

    Joins on exploded references, so any number of sources may go at once.
    """
    refs = claims.select("claim_id", F.posexplode("source_refs").alias("pos", "r")).join(gone.select(F.col("source_id").alias("g")), F.col("r.source_id") == F.col("g"), "left_anti")
    left = refs.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]).alias("kept_refs"))
    rows = claims.join(left, "claim_id", "left")
    kept = rows.where("kept_refs IS NOT NULL").withColumns({"source_refs": F.col("kept_refs"), "source_ids": F.array_distinct(F.transform("kept_refs", lambda r: r["source_id"])), "chunk_ids": F.array_distinct(F.array_compact(F.transform("kept_refs", lambda r: r["chunk_id"])))}).drop("kept_refs")
    return kept, rows.where("kept_refs IS NULL").drop("kept_refs").withColumn("lifecycle_status", F.lit("archived"))


def retract_from_reviews(reviews: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, historical): reviews without the claims of ``gone`` (claim_id); those without candidates go to history."""
    left = reviews.select("review_id", F.posexplode("candidate_claim_ids").alias("pos", "claim_id")).join(gone.select("claim_id"), "claim_id", "left_anti")
    left = left.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim_id"))), lambda x: x["claim_id"]).alias("left_ids"))
    rows = reviews.join(left, "review_id", "left")
    kept = rows.where("left_ids IS NOT NULL").withColumn("candidate_claim_ids", F.col("left_ids")).drop("left_ids")
    return kept, rows.where("left_ids IS NULL").drop("left_ids").withColumn("lifecycle_status", F.lit("archived"))


def to_history(rows: DataFrame, id_col: str, archived_at: Column) -> DataFrame:
    """Rows under historical ids that keep the original one."""
    return rows.withColumns({"original_id": F.col(id_col), id_col: ids.historical_id(F.lit(None).cast("string"), F.col(id_col), archived_at), "archived_at": archived_at})


def by_any_id(live: DataFrame, history: DataFrame, id_col: str) -> DataFrame:
    """(key, found_id, live): rows under current and original ids; current ones win."""
    a = live.select(F.col(id_col).alias("key"), F.col(id_col).alias("found_id"), F.lit(1).alias("live"))
    b = history.select(F.explode(F.array_compact(F.array(id_col, "original_id"))).alias("key"), F.col(id_col).alias("found_id"), F.lit(0).alias("live"))
    return a.unionByName(b).groupBy("key").agg(F.max_by("found_id", F.struct("live", "found_id")).alias("found_id"), F.max("live").alias("live"))


def alias_conflict_reviews(conflicts: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open ones, ids to archive): a review per alias conflict; open alias reviews whose conflict is gone."""
    now = conflicts.select(ids.review_id(F.lit("alias_conflict"), F.array("signature")).alias("review_id"), F.lit("alias_conflict").alias("kind"), F.lit("open").alias("status"), "alias", "canonical_ids")
    gone = existing.where("kind = 'alias_conflict' AND status = 'open'").join(now.select("review_id"), "review_id", "left_anti").select("review_id")
    return now, gone


def remove_page(rows: DataFrame, page_id: str, column: str = "page_ids") -> DataFrame:
    return rows.withColumn(column, F.array_remove(column, page_id))


def back_references(pages: DataFrame) -> DataFrame:
    """(claim_id, page_ids) from pages' claims."""
    return pages.select("page_id", F.explode("claim_ids").alias("claim_id")).groupBy("claim_id").agg(F.sort_array(F.collect_set("page_id")).alias("page_ids"))
