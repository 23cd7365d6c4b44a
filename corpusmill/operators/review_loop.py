"""The review loop: decisions that depend on each other, run to a fixpoint on all reviews at once.

One by one, open reviews are planned in order, each on the claims as the ones before left them; what
is safe is done, and every other review sees it: losers of a merge are replaced by their primary,
archived ones dropped, and a review with fewer than two claims left is resolved. Passes repeat until
one does nothing. Here, all reviews of a pass that are the first of those still waiting for each of
their claims are planned at once. They share no claim, and none that comes before them can reach
their claims any more, so the outcome is that of one by one; rounds grow with the longest chain of
reviews that share claims, not with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stages import staged
from .reviews import actionable


def _ready(rows: DataFrame) -> DataFrame:
    """Rows of waiting reviews that come first at each of their claims."""
    waiting = rows.where("NOT planned")
    first = waiting.groupBy("claim_id").agg(F.min("at").alias("first"))
    late = waiting.join(first, "claim_id").where("first < at").select("review_id").distinct()
    return waiting.join(late, "review_id", "left_anti")


def _planned(ready: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(review_id, kind, at, action, primary_claim_id, other): what is safe to do, by the rules of ``reviews.plans``."""
    n = sources.groupBy("claim_id").agg(F.count("*").alias("sources"))
    each = ready.join(claims.select("claim_id", "size"), "claim_id", "left").join(n, "claim_id", "left")
    rank = F.when(F.col("size").isNotNull(), F.struct(F.coalesce("sources", F.lit(0)).alias("sources"), "size", "claim_id"))
    g = each.groupBy("review_id", "kind", "at").agg(F.count("*").alias("n"), F.count("size").alias("live"), F.max(rank).alias("best"), F.min(rank).alias("least"))
    pair = (F.col("n") == 2) & (F.col("live") == 2)
    far = F.col("best.sources") >= F.col("least.sources") + 2
    # The least rank may have as many sources as the best; of a conflict, the side with fewer sources is the other one.
    action = F.when(pair & (F.col("kind") == "claim_duplicate"), "merge").when(pair & (F.col("kind") == "claim_conflict"), F.when(far, "archive_one").otherwise("keep_both")).otherwise("wait")
    return g.select("review_id", "kind", "at", action.alias("action"), F.col("best.claim_id").alias("primary_claim_id"), F.col("least.claim_id").alias("other"))


def settled(reviews: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(actions, claims, reviews) when nothing safe is left to do.

    Actions: review_id, pass, round, action, primary_claim_id, other, one for each review that was
    acted on. Claims: claim_id, lifecycle_status, superseded_by, sources (distinct ones that a live
    claim holds, its losers' included), chains of merges followed to their end. Reviews: review_id,
    status, candidate_claim_ids as they are now. Reviews that are not open or not live stay as they
    are; claims that aren't in ``claims`` count as candidates, but nothing is done to their reviews.
    Needs reviews with created_at, and claims with source_ids and text.
    """
    order = F.struct(F.coalesce("created_at", F.lit("")).alias("created_at"), "review_id")
    open_ = actionable(reviews).select("review_id", "kind", order.alias("at"), F.explode(F.array_distinct("candidate_claim_ids")).alias("claim_id"))
    rows = staged(open_.withColumn("planned", F.lit(False)), "loop_reviews")
    known = staged(claims.select("claim_id", F.length(T.clean_claim("text")).alias("size")), "loop_claims")
    sources = staged(claims.select("claim_id", F.explode(F.array_distinct("source_ids")).alias("source_id")), "loop_sources")
    held = staged(claims.select("claim_id", F.col("claim_id").alias("holder")), "loop_holders")
    done, turn, round_, acted = [], 0, 0, False
    while True:
        plan = staged(_planned(_ready(rows), sources, known), "loop_plan")
        if plan.isEmpty():
            if not acted:
                break
            turn, acted = turn + 1, False
            rows = staged(rows.withColumn("planned", F.lit(False)), "loop_reviews")
            continue
        acts = plan.where("action <> 'wait'")
        moves = acts.where("action IN ('merge', 'archive_one')").select(F.col("other").alias("claim_id"), F.when(F.col("action") == "merge", F.col("primary_claim_id")).alias("to"), F.lit(True).alias("moved"))
        some = not acts.isEmpty()
        seen = rows.join(plan.select("review_id", F.lit(True).alias("now")), "review_id", "left").withColumn("planned", F.col("planned") | F.coalesce("now", F.lit(False))).drop("now")
        if some:
            acted = True
            done.append(acts.select("review_id", F.lit(turn).alias("pass"), F.lit(round_).alias("round"), "action", "primary_claim_id", "other"))
            seen = seen.join(acts.select("review_id"), "review_id", "left_anti").join(moves, "claim_id", "left")
            seen = seen.withColumn("claim_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("claim_id"))).where("claim_id IS NOT NULL").drop("to", "moved").distinct()
            few = seen.groupBy("review_id").agg(F.count("*").alias("n")).where("n < 2").select("review_id")
            seen = seen.join(few, "review_id", "left_anti")
            over = lambda table: table.join(moves, "claim_id", "left").withColumn("claim_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("claim_id"))).where("claim_id IS NOT NULL").drop("to", "moved")  # noqa: B023, E731
            sources = staged(over(sources).distinct(), "loop_sources")
            ends = moves.select(F.col("claim_id").alias("holder"), F.coalesce("to", F.lit("")).alias("to"))
            held = staged(held.join(ends, "holder", "left").select("claim_id", F.coalesce("to", "holder").alias("holder")), "loop_holders")
            known = staged(known.join(moves.select("claim_id"), "claim_id", "left_anti"), "loop_claims")
        rows = staged(seen, "loop_reviews")
        round_ += 1
    schema = "review_id string, pass int, round int, action string, primary_claim_id string, other string"
    actions = reviews.sparkSession.createDataFrame([], schema)
    for part in done:
        actions = actions.unionByName(part)
    n = sources.groupBy(F.col("claim_id").alias("holder")).agg(F.count("*").alias("sources"))
    ends = held.join(n, "holder", "left")
    life = F.when(F.col("holder") == F.col("claim_id"), "active").when(F.col("holder") == "", "archived").otherwise("superseded")
    out = ends.select("claim_id", life.alias("lifecycle_status"), F.when(life == "superseded", F.col("holder")).alias("superseded_by"), F.when(life == "active", F.coalesce("sources", F.lit(0))).alias("sources"))
    now = rows.groupBy("review_id").agg(F.sort_array(F.collect_set("claim_id")).alias("now"))
    was_open = open_.select("review_id").distinct().withColumn("was_open", F.lit(True))
    left = reviews.join(now, "review_id", "left").join(was_open, "review_id", "left")
    closed = F.col("was_open") & F.col("now").isNull()
    left = left.select("review_id", F.when(closed, "resolved").otherwise(F.col("status")).alias("status"), F.when(F.col("was_open"), F.coalesce("now", F.array().cast("array<string>"))).otherwise(F.col("candidate_claim_ids")).alias("candidate_claim_ids"))
    return actions, out, left
