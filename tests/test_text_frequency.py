"""Document frequencies without postings: equal to those of postings, and nothing is shuffled by page."""

from corpusmill.operators import search as X

SCHEMA = "page_id string, title string, aliases array<string>, hierarchy array<string>, summary string, claim_texts array<string>, source_paths array<string>, page_text string"


def page(page_id, text):
    return (page_id, text.split("\n")[0], ["al"], ["en", None], text, text.split("\n"), ["raw/x"], text)


def rows_of(frame):
    return sorted((r.field, r.token, r.df) for r in frame.collect())


def test_equals_postings_with_repeated_ids(spark):
    for ids in (["a", "b", "c"], ["a", "a", "b"], [None, None, "b"]):
        pages = spark.createDataFrame([page(i, t) for i, t in zip(ids, ["one two two\nthree", "two four", ""])], SCHEMA)
        assert rows_of(X.text_frequency(pages)) == rows_of(X.document_frequency(X.postings(X.page_fields(pages))))


def test_only_counts_by_token_are_shuffled(spark):
    pages = spark.createDataFrame([page("a", "one two"), page("b", "two")], SCHEMA)
    plan = X.text_frequency(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    assert plan.count("[a-z0-9_]+") == 1
