import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names operators use inside; they must not get in the way.
CLASH = ", id long, fp long, key string, th long, node long, pos int, spans string, ids string, score double, payload string, shard int"
LONG = "wordy " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing columns."""
    base = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
        (3, None, "en", "a", None),
        (None, "the quick brown fox jumps over the lazy dog", None, None, 43),
        (None, None, None, None, None),
        (4, "", "fr", "a", 0),
        (5, " \n\t ", "fr", "a", 4),
        (6, LONG, "en", "a", len(LONG)),
        (2**60 + 1, "été à la plage 😀 <|endoftext|> 你好", "fr", None, 30),
    ]
    rows = [(*r, 1, 2, "k", 3, 4, 5, "s", "i", 0.5, "p", 6) for r in base]
    return spark.createDataFrame(rows, DOCS + CLASH)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
