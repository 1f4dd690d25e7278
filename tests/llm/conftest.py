import pytest

DATA = "/root/testdata/sf0.001"

WORDS = "the river runs past an old mill and over seven stones before it meets the quiet sea".split()
PLAIN = " ".join(WORDS)
LONG = " ".join(f"{w}{i % 97}" for i, w in enumerate(WORDS * 2500))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


#: Nulls, empty and blank texts, a very long one, repeated rows, ties, and columns named like results.
ODD_ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "  \n ", None, "a"), (4, LONG, "en", "a"), (5, PLAIN, "en", "b"), (5, PLAIN, "en", "b"),
    (6, PLAIN, None, None), (None, PLAIN, "en", "b"), (None, None, None, None), (7, "🙂 ▁ ünï – 12", "de", "c"), (8, "12345", "de", "c"), (9, "x", None, "c"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, ids string, decoded int, lang_pred int, block string, slot int, place int, number int, k1 string, start string, n string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(i, text, lang, source, None if text is None else len(text), *[None] * 12) for i, text, lang, source in ODD_ROWS]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
