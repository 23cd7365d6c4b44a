"""The review loop against one-by-one application on random review graphs."""

import random

import pytest

from corpusmill.operators import review_loop as L

TEXT = "a claim about the thing number"


def one_by_one(reviews, claims):
    """Passes over open reviews in order, each planned on what the ones before left."""
    claims = {c: (set(s), len(t)) for c, s, t in claims}
    todo = {r: (kind, list(dict.fromkeys(cs))) for r, at, kind, status, cs in sorted(reviews, key=lambda r: (r[1], r[0])) if status == "open"}
    into, log, acted = {}, [], True
    while acted:
        acted = False
        for r in list(todo):
            if r not in todo or len(todo[r][1]) != 2 or any(c not in claims for c in todo[r][1]):
                continue
            kind, pair = todo.pop(r)
            acted = True
            least, best = sorted(pair, key=lambda c: (len(claims[c][0]), claims[c][1], c))
            if kind == "claim_duplicate":
                action = "merge"
            else:
                action = "archive_one" if len(claims[best][0]) >= len(claims[least][0]) + 2 else "keep_both"
            log.append((r, action, best, least))
            if action == "keep_both":
                continue
            gained, _ = claims.pop(least)
            into[least] = best if action == "merge" else ""
            if action == "merge":
                claims[best][0].update(gained)
            for q, (k, cs) in list(todo.items()):
                cs = list(dict.fromkeys(best if c == least and action == "merge" else c for c in cs if c != least or action == "merge"))
                if len(cs) < 2:
                    todo.pop(q)
                else:
                    todo[q] = (k, cs)
    return sorted(log), claims, into, {r: sorted(cs) for r, (_, cs) in todo.items()}


def end(c, into):
    while into.get(c):
        c = into[c]
    return "" if c in into else c


@pytest.mark.parametrize("seed", range(2))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    claims = [(f"c{i:02}", [f"s{k}" for k in rng.sample(range(9), rng.randint(1, 5))], TEXT + " x" * rng.randint(0, 3)) for i in range(24)]
    reviews = []
    for i in range(22):
        cs = [c for c, _, _ in rng.sample(claims, rng.choice([2, 2, 2, 3, 4]))] + (["gone"] if rng.random() < 0.1 else [])
        reviews.append((f"r{i:02}", f"2024-{rng.randint(1, 9)}", rng.choice(["claim_duplicate", "claim_duplicate", "claim_conflict"]), "open" if rng.random() < 0.9 else "resolved", cs))
    frame = spark.createDataFrame([(*r, "active") for r in reviews], "review_id string, created_at string, kind string, status string, candidate_claim_ids array<string>, lifecycle_status string")
    actions, after, left = L.settled(frame, spark.createDataFrame(claims, "claim_id string, source_ids array<string>, text string"))
    log, live, into, still = one_by_one(reviews, claims)
    assert sorted((r.review_id, r.action, r.primary_claim_id, r.other) for r in actions.collect()) == log and len(log) > 3
    for r in after.collect():
        if r.claim_id in live:
            assert (r.lifecycle_status, r.superseded_by, r.sources) == ("active", None, len(live[r.claim_id][0]))
        else:
            assert (r.superseded_by or "") == end(r.claim_id, into) and r.lifecycle_status == ("superseded" if r.superseded_by else "archived")
    by = {r[0]: r for r in reviews}
    for r in left.collect():
        want = ("open", still[r.review_id]) if r.review_id in still else ("resolved", [] if by[r.review_id][3] == "open" else by[r.review_id][4])
        assert (r.status, r.candidate_claim_ids) == want


def test_chains_end_at_the_last(spark):
    """A into B, then B into C: A's sources reach C."""
    claims = spark.createDataFrame([("a", ["s1"], TEXT), ("b", ["s2", "s3"], TEXT), ("c", ["s4", "s5", "s6", "s7"], TEXT)], "claim_id string, source_ids array<string>, text string")
    reviews = spark.createDataFrame([("r1", "1", "claim_duplicate", "open", ["a", "b"], "active"), ("r2", "2", "claim_duplicate", "open", ["b", "c"], "active")], "review_id string, created_at string, kind string, status string, candidate_claim_ids array<string>, lifecycle_status string")
    _, after, left = L.settled(reviews, claims)
    assert {r.claim_id: (r.superseded_by, r.sources) for r in after.collect()} == {"a": ("c", None), "b": ("c", None), "c": (None, 7)}
    assert {r.status for r in left.collect()} == {"resolved"}
    actions, after, left = L.settled(reviews.where("false"), claims.where("false"))
    assert actions.count() == after.count() == left.count() == 0
