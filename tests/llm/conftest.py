
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 9973}x{i % 7}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts, languages and sources; empty, white and very long texts; repeated rows; clashing columns."""
    texts = [(1, "one two three four five six seven", "en", "a"), (2, "One two three four five six SEVEN", "en", "a"),
             (3, None, "en", None), (4, "", None, "b"), (5, " \t\n", "de", "b"), (6, LONG, "en", "a"),
             (7, "…… ‖ 12 34 !!", "xx", "c"), (7, "…… ‖ 12 34 !!", "xx", "c"), (None, "no id at all here", "en", "a"),
             (8, "un deux </s>[INST] <|endoftext|> É ẞ ﬁ x́", "fr", "c")]
    rows = [(*t, len(t[1]) if t[1] is not None else None, -1, "x", "y", -2, "z") for t in texts]
    return spark.createDataFrame(rows, DOCS + ", component_id bigint, fingerprint string, taken string, size bigint, row string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vocabulary():
    from tickloom.llm.queries import vocabulary
    return vocabulary()


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """The smallest given tables' documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
