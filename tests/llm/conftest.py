import pytest

#: Null and empty texts, repeated rows, copies, a long text, no id, names that clash.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "The quick  brown\tfox jumps over\nthe lazy dog"),
    (3, None),
    (4, ""),
    (5, " \n"),
    (6, "une phrase en français, avec des accents: éèê"),
    (6, "une phrase en français, avec des accents: éèê"),
    (None, "The quick brown fox jumps over the lazy dog"),
    (7, "word " * 3000),
    (8, "12345 67890 !!"),
    (9, 'token = "abcDEF123456" and AKIA' + "Q" * 16 + " " + "0123456789abcdef" * 2 + " 😀"),
]
SCHEMA = "doc_id long, text string, lang string, source string, shard int, ids int, fp long, id string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else "fr", "a" if (i or 9) < 9 else None, 7, 1, 2, "x", "k") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
