"""Sharding and mixing."""

import random
import zlib
from collections import Counter, defaultdict

from corpusmill.llm import mixing, sharding


def test_shards_are_balanced_contiguous_and_gapless(spark):
    rows = [(i, "x" * ((i * 37) % 91)) for i in range(500)]
    got = sorted(sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect())
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(7))
    for rs in by.values():
        assert [r.slot for r in rs] == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 7) <= largest


def test_shards_equal_one_pass_in_python(spark):
    """A row goes to the shard in which its first byte lies when all rows stand in order of id."""
    rng = random.Random(4)
    rows = [(i * 3 % 1009, rng.choice(["", "é" * rng.randint(0, 40), "x" * rng.randint(0, 2000), None])) for i in range(1, 900)]
    got = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24).collect()}
    sizes = {i: len((t or "").encode()) + 8 for i, t in rows}
    total, at, want, slots = sum(sizes.values()), 0, {}, Counter()
    for i, t in sorted(rows, key=lambda r: r[0]):
        shard = at * 24 // total
        want[i] = (sizes[i], zlib.crc32((t or "").encode()), shard, slots[shard])
        slots[shard] += 1
        at += sizes[i]
    assert got == want


def test_shards_edge_cases(docs, no_docs):
    got = sharding.balanced_shards(docs, 3).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.size for r in got}[3] == 8 and {r.doc_id: r.text_crc32 for r in got}[3] == 0
    assert sharding.balanced_shards(no_docs, 3).count() == 0


def test_mix_meets_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.systematic_mix(frame).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source_key] += r.taken
        size[r.source_key] += r.size
        target[r.source_key] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s, t in target.items():
        assert t <= 2 * size[s] + 1e-9 and abs(taken[s] - t) <= 2 * 17
    again = mixing.systematic_mix(frame.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_edge_cases(docs, no_docs):
    got = mixing.systematic_mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.systematic_mix(no_docs).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mixed_rows_keep_what_they_differ_in(spark):
    rows = [(1, "a b c", "s", "p", 1), (1, "a b c", "s", "q", 2), (2, "d e f", "s", "p", 1), (2, "d e f", "s", "p", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string, copies int")
    got = Counter(map(tuple, mixing.mixed_documents(frame).collect()))
    copies = sum(r.copies for r in mixing.systematic_mix(frame).collect())
    assert sum(got.values()) == copies and set(got) == set(rows)
