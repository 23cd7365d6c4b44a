"""Pages as files: what differs is replaced, a failing job leaves old pages whole, broken commits are finished."""

import json
import os

import pytest

from corpusmill.sources import page_sink as W


def frame(spark, pages):
    return spark.createDataFrame(list(pages.items()), "page_path string, page_text string").repartition(3)


def found(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            p = os.path.relpath(os.path.join(folder, n), root)
            if not n.endswith(".crc"):
                out[p] = open(os.path.join(root, p), encoding="utf-8").read()
    return out


def test_only_changed_pages_are_replaced(spark, tmp_path):
    root = str(tmp_path / "wiki")
    pages = {"a.md": "A", "topics/b.md": "B ü\n", "topics/deep/c.md": ""}
    W.write_pages(frame(spark, pages), root)
    assert found(root) == pages
    kept = os.stat(f"{root}/a.md").st_mtime_ns
    pages |= {"topics/b.md": "B2", "d.md": "D"}
    W.write_pages(frame(spark, pages), root)
    assert found(root) == pages and os.stat(f"{root}/a.md").st_mtime_ns == kept
    W.write_pages(frame(spark, {"a.md": None}), root)
    assert found(root) == pages | {"a.md": ""}


def test_failing_tasks_leave_old_pages(spark, tmp_path):
    root = str(tmp_path / "wiki")
    old = {f"p{i}.md": f"old {i}" for i in range(9)}
    W.write_pages(frame(spark, old), root)
    with pytest.raises(Exception, match="can't stand at"):
        W.write_pages(frame(spark, {p: "new" for p in old} | {"../outside.md": "x"}), root)
    assert found(root) == old and not os.path.exists(tmp_path / "outside.md")


def test_broken_commits_are_finished(tmp_path):
    root = tmp_path / "wiki"
    held = root / "_staged" / "run"
    for p, text in (("_lists/0-0", "a.md\nb.md"), ("b.md", "B")):  # a.md was moved before the driver was lost
        (held / p).parent.mkdir(parents=True, exist_ok=True)
        (held / p).write_text(text)
    (root / "a.md").write_text("A")
    (root / "_commits").mkdir()
    (root / "_commits" / "run").write_text(json.dumps(["0-0"]))
    assert W.recover(str(root)) == ["run"] and W.recover(str(root)) == []
    assert found(str(root)) == {"a.md": "A", "b.md": "B"}
