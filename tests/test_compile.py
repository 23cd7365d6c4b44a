"""The compile chain on small notes, joins and reviews."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import claims as C
from corpusmill.operators import reviews as R
from corpusmill.operators import search as X
from corpusmill.operators import similarity as N
from corpusmill.operators import structure as S
from corpusmill.sources import files, tables
from corpusmill.streaming import incremental as I

NOTE = """# 运营工作说明

## 平台运营组

负责人：许颖超

- **职责**
负责平台的日常运营工作安排。

| 字段 | 值 |
| --- | --- |
| 地点 | 上海 |

```
code
```
"""


def sources(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return tables.as_sources(rows, F.format_string("raw/n%d.md", F.col("i")), F.col("i"), F.format_string("n%d", F.col("i")), F.col("t"), "markdown")


def test_chain(spark):
    src = sources(spark, NOTE)
    blocks, evidence, units = S.compile_structure(src)
    kinds = [r.block_kind for r in evidence.orderBy("start_line").collect()]
    assert kinds == ["section_heading", "section_heading", "metadata_line", "list_item_with_body", "table_row", "table_row", "code_example"]
    assert blocks.where("block_type = 'paragraph'").first().heading_path_parts == ["运营工作说明", "平台运营组"]
    got = C.claims(units, S.chunks(src)).collect()
    by = {r.text: r for r in got}
    assert by["平台运营组 负责人 是 许颖超"].claim_type == "metadata_fact" and "平台运营组 地点 是 上海" in by


def test_fences_and_stacks(spark):
    src = sources(spark, "# A\n### C\n## B\ntext\n```\nopen")
    blocks = {r.text: r for r in S.structure_blocks(src).collect()}
    assert blocks["text"].heading_path_parts == ["A", "B"] and blocks["```\nopen"].block_type == "paragraph"
    parts = [r.parts for r in S.sections(sources(spark, "# A\n### C\n## B\n")).orderBy("line_no").collect()]
    assert parts == [["A"], ["A", "C"], ["A", "B"]]


def test_chunks_pack_greedily(spark):
    text = "\n\n".join("x" * n for n in (3000, 1500, 5000, 2000, 100))
    got = [(r.start_line, r.end_line, r.chunk_index) for r in S.chunks(sources(spark, text)).orderBy("chunk_index").collect()]
    assert got == [(1, 3, 0), (5, 5, 1), (7, 9, 2)]


@pytest.mark.parametrize(
    ("left", "right", "similar"),
    [("the system must keep back links for every claim", "the system must keep back links for each claim", True), ("bananas are yellow fruits of summer", "the parser reads tables row by row", False), ("we do not delete archived claims here", "we do delete archived claims here", True)],
)
def test_similarity(spark, left, right, similar):
    rows = spark.createDataFrame([("a", left, 0), ("b", right, 1)], "claim_id string, text string, ord int").withColumns({"normalized_text": F.lower("text"), "line": F.lit(1), "pos": F.lit(0)})
    got = N.claim_reviews(rows).collect()
    assert bool(got) is similar
    if "not" in left:
        assert got[0].kind == "claim_conflict"


def test_retraction_and_reviews(spark):
    src = sources(spark, "One claim that stands.\nShared claim of two notes.", "Shared claim of two notes.")
    _, _, units = S.compile_structure(src)
    merged = C.merge_claims(C.claims(units, S.chunks(src)))
    gone = src.where("ord = 0").select("source_id")
    kept, history = R.retract_sources(merged, gone)
    assert kept.count() == 1 and [r.text for r in history.collect()] == ["One claim that stands"]
    assert all(gone.first().source_id not in r.source_ids for r in kept.collect())


def test_incremental_equals_batch(spark, tmp_path):
    a, b = "First note has a claim.", "Second note has another claim."
    store = I.Store(spark, str(tmp_path / "s"))
    both = sources(spark, a, b)
    I.apply_batch(store, both.where("ord = 0"))
    I.apply_batch(store, both)
    assert I.apply_batch(store, both) is None
    one = I.Store(spark, str(tmp_path / "t"))
    I.apply_batch(one, both)
    key = lambda s: sorted((r.claim_id, r.text) for r in I.merged_claims(s).collect())
    assert key(store) == key(one) and len(key(one)) == 2
    I.tombstones(store, both.where("ord = 0"))
    assert len(key(store)) == 1
    I.apply_batch(store, both)  # the retracted note comes back
    assert key(store) == key(one) and store.read("sources").count() == 2


def test_intents_and_converters(spark):
    got = X.queries_frame(spark, ["How to trace", "what is x", "resource", "plain"]).orderBy("query_id").collect()
    assert [r.intent for r in got] == ["how_to", "definition", "evidence", "lookup"]
    assert files.convert("a.csv", "spreadsheet", b"a,b\n1,2\n")[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert files.convert("a.docx", "docx", b"broken")[2] == "failed" and files.convert("a.xyz", "unknown", b"")[2] == "poor"
    assert files.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")) == (7, 9)
