import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, key string, path string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long_ = "the cat sat on a mat and " * 4000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog today", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog today", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, "   \n\t ", "fr", None),
        (6, long_, "en", "b"),
        (7, long_ + "x", "en", "b"),
        (8, "le chat est sur la table et le chien dort", "fr", "c"),
        (9, "12 34 -- 56", None, "c"),
        (None, "a text without an id", "en", "a"),
        (10, "word", "en", "a"),
        (11, "w" * 70_000, "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y", "z", 1.0) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))
