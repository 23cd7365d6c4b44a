"""Texts are worked out once: no filter of a generator brings their rules into the plan again."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import claims as C
from corpusmill.operators import structure as S

PIECES = "(?<=\\.)\\s{2,}"  # stands once in the rule that cuts a text into sentences


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_stand_once_in_the_plan(spark):
    text = "# A\n\nThe first claim is long enough. And more here。Second one!\n"
    rows = spark.createDataFrame([("s", "raw/s.md", 1, text), ("t", "raw/t.md", 2, "")], "source_id string, source_path string, ord long, text string")
    _, _, units = S.compile_structure(rows)
    chunks = S.chunks(rows)
    assert optimized(C.unit_claims(units, chunks)).count(PIECES) == 1
    assert optimized(C.chunk_claims(chunks)).count(PIECES) == 1
    assert [r.text for r in C.claims(units, chunks).orderBy("pos").collect()] == ["The first claim is long enough. And more here", "Second one"]


def test_lines_are_split_once(spark):
    rows = spark.createDataFrame([("s", "p", 1, "a\n\nb\n"), ("t", "p", 2, ""), ("u", "p", 3, None)], "source_id string, source_path string, ord long, text string")
    found = S.lines(rows)
    assert optimized(found).count("split(") == 1
    assert sorted((r.source_id, r.line_no, r.line) for r in found.collect()) == [("s", 1, "a"), ("s", 2, ""), ("s", 3, "b"), ("t", 1, "")]


def test_front_and_blanks_as_before(spark):
    x = ["  # > - 1. （2） 因此  text　 end ", " a\t b\u0085", "什么是 A A is this", "a<!-- b -->c", "1) 2、x", "ab1", "ab12", "key word: value"]
    rows = spark.createDataFrame([(v,) for v in x], "x string").select(T.clean_claim("x").alias("c"), T.strip("x").alias("s"), T.noise(F.col("x")).alias("n")).collect()
    assert [r.c for r in rows][:5] == ["text end", "a b", "A is this", "a c", "2、x"]
    assert rows[1].s == "a\t b"
    assert [r.n for r in rows][5:] == [True, False, True]
