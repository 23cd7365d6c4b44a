"""The store against a fresh compile after any history of files; pages by what changed; compaction."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ids
from corpusmill.streaming import incremental as I

CONTENTS = ["First note has a claim.", "Second note has another claim.", "# Topic words\n\nA shared statement of two notes.\nOne more line stands here."]


def scan(spark, files):
    """Files as a scan: path -> content; ord and title follow the path."""
    rows = [(p, c, ord(p[0])) for p, c in files.items()]
    rows = spark.createDataFrame(rows, "source_path string, text string, ord long")
    rows = rows.withColumns({"source_type": F.lit("markdown"), "title": F.concat(F.lit("t "), "source_path"), "source_hash": ids.digest(F.col("text"))})
    return rows.withColumn("source_id", ids.source_id(F.col("source_path"), F.col("source_hash")))


def bare(rows):
    return {"sources": rows}


def live(store):
    rows = store.read("sources")
    return [] if rows is None else sorted((r.source_path, r.text, r.ord, r.title) for r in rows.collect())


def wanted(files):
    first = {}
    for p in sorted(files):
        first.setdefault(files[p], p)
    return sorted((p, c, ord(p[0]), "t " + p) for c, p in first.items())


@pytest.mark.parametrize("seed", [1])
def test_histories(spark, tmp_path, seed):
    """Renames, copies, swaps, edits and deletions in any order leave what a fresh batch of the last state gives."""
    rng, files, store = random.Random(seed), {"b.md": "X", "c.md": "Y"}, I.Store(spark, str(tmp_path / "s"))
    I.apply_batch(store, scan(spark, files), True, bare)
    for step in range(4):
        paths = sorted(files)
        act = rng.choice(["rename", "copy", "swap", "edit", "delete", "new", "compact"])
        if act == "compact":
            I.Store.compact(store)
        elif act == "swap" and len(paths) > 1:
            p, q = rng.sample(paths, 2)
            files[p], files[q] = files[q], files[p]
        elif act in ("rename", "copy") and paths:
            p = rng.choice(paths)
            files[rng.choice("abcdef") + ".md"] = files[p] if act == "copy" else files.pop(p)
        elif act == "delete" and len(paths) > 1:
            files.pop(rng.choice(paths))
        else:
            files[rng.choice("abcdef") + ".md"] = rng.choice("XYZ")
        made = I.apply_batch(store, scan(spark, files), True, bare)
        assert live(store) == wanted(files), (step, act)
        assert made is None or made == store.last()
    assert I.apply_batch(store, scan(spark, files), True, bare) is None


def test_parts_of_files(spark, tmp_path):
    """Scans of some files change those alone; content stays while any path has it."""
    store = I.Store(spark, str(tmp_path / "s"))
    I.apply_batch(store, scan(spark, {"a.md": "X", "b.md": "X"}), compiled=bare)
    I.apply_batch(store, scan(spark, {"a.md": "Y"}), compiled=bare)
    assert live(store) == wanted({"a.md": "Y", "b.md": "X"})
    I.apply_batch(store, scan(spark, {"c.md": "Y"}), compiled=bare)
    assert I.tombstones(store, scan(spark, {"b.md": "X", "c.md": "Y"})) is not None
    assert live(store) == wanted({"b.md": "X", "c.md": "Y"})
    twice = scan(spark, {"b.md": "X"}).unionByName(scan(spark, {"b.md": "Z"}).withColumn("ord", F.lit(1000).cast("long")))
    I.apply_batch(store, twice, compiled=bare)
    assert [r[:2] for r in live(store)] == [("b.md", "Z"), ("c.md", "Y")]


def test_failed_batches(spark, tmp_path):
    """What a batch without a commit left is not seen, and goes when its number is used."""
    store = I.Store(spark, str(tmp_path / "s"))
    I.apply_batch(store, scan(spark, {"a.md": "X"}), compiled=bare)
    junk = store.read("sources").withColumn("text", F.lit("junk"))
    store.write("sources", junk, store.last() + 1)
    assert [r[1] for r in live(store)] == ["X"]
    I.apply_batch(store, scan(spark, {}), True, bare)
    assert live(store) == []
    empty = I.Store(spark, str(tmp_path / "none"))
    assert empty.compact() is None and I.tombstones(empty, scan(spark, {})) is None and I.apply_batch(empty, scan(spark, {}), True, bare) is None


def pages(store):
    rows = store.read("pages")
    return sorted((r.page_key, r.page_path, r.signature, r.claim_ids, r.source_ids) for r in rows.drop("page_text").collect())


def claims(store):
    return sorted((r.normalized_text, r.claim_id, r.source_ids, r.chunk_ids) for r in store.read("claims").collect())


def test_pages_follow_what_changed(spark, tmp_path):
    """After each batch claims and pages equal a full compile; untouched pages are not written."""
    store = I.Store(spark, str(tmp_path / "s"))
    history = [{"a.md": CONTENTS[0], "b.md": CONTENTS[2]}, {"b.md": CONTENTS[2], "c.md": CONTENTS[1] + "\n" + CONTENTS[2]}]
    for k, files in enumerate(history):
        assert I.apply_batch(store, scan(spark, files), True, pages=True) == k
    fresh = I.Store(spark, str(tmp_path / "f"))
    I.apply_batch(fresh, scan(spark, files), True, pages=True)
    assert claims(store) == claims(fresh) and pages(store) == pages(fresh) and pages(fresh)
    assert I.apply_batch(store, scan(spark, files), True, pages=True) is None
    written = {(r.page_key, r.dead) for r in spark.read.parquet(f"{store.root}/pages").where("batch = 1").collect()}
    assert any(key.startswith("source:src_a") and dead for key, dead in written) and len(written) < len(pages(store)) + 3
    before = pages(store), claims(store)
    assert store.compact() == 1 and (pages(store), claims(store)) == before


def test_new_titles_reach_pages(spark, tmp_path):
    """A source of a new title has a new page file; pages of its claims link there, though no claim changed."""
    files, store, fresh = {"a.md": CONTENTS[2], "b.md": CONTENTS[0]}, I.Store(spark, str(tmp_path / "s")), I.Store(spark, str(tmp_path / "f"))
    renamed = scan(spark, files).withColumn("title", F.when(F.col("source_path") == "a.md", "new words").otherwise(F.col("title")))
    I.apply_batch(store, scan(spark, files), True, pages=True)
    I.apply_batch(store, renamed, True, pages=True)
    I.apply_batch(fresh, renamed, True, pages=True)
    assert pages(store) == pages(fresh) and store.read("claims").count() == fresh.read("claims").count()
    assert any("new%20words" in r.page_text for r in store.read("pages").where("type IN ('concept', 'topic')").collect())
