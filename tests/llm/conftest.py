import pytest

#: Null and empty texts, no letters, ties and repeated rows, a long text; a column of an own name.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the house", "en", "a"), (2, "the quick brown fox jumps over the lazy dog and runs away from the house", "en", "a"), (2, "the quick brown fox jumps over the lazy dog and runs away from the house", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "en", "b"), (6, "12 34 !!", "de", "b"), (7, "one two", "en", "c"), (8, "der schnelle braune Fuchs springt über den faulen Hund", "de", "c"), (9, "lang " * 30000, "de", None), (None, "no id at all", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, key string, n long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
