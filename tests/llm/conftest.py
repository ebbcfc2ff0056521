import pytest

LONG = " ".join(f"word{i} of{i % 97} the" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD_ROWS = [
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 58, "x"),
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 58, "x"),
    (2, "the CAT sat on the mat and looked at the moon for a while.", None, None, None, None),
    (3, None, "en", None, None, "y"),
    (4, "", None, "b", 0, ""),
    (5, " \t\n ", "en", "b", 4, ""),
    (6, "one", "en", "b", 3, ""),
    (7, "12 34 !!", "en", "b", 8, ""),
    (8, LONG, "en", "b", None, ""),
    (9, LONG + " end", "en", "b", None, ""),
    (None, "Ein Satz ohne Nummer steht hier ganz allein im Regen.", "de", "b", 5, ""),
    (None, None, None, None, None, None),
    (10, "é" * 300, "fr", "b", 300, ""),
    (11, "x" + PASSAGE + " début", "fr", "b", 1, ""),
    (12, "yy" + PASSAGE + "é<|endoftext|> fin  double  spaces \x1c Σας ﬀ", "fr", "b", 1, ""),
    (12, "Another text under the same number, which is allowed.", "en", "b", 1, ""),
    (13, "a\n\nb\nc c c\n", "en", "b", 1, ""),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, H string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, an extra column."""
    df = spark.createDataFrame(ODD_ROWS, SCHEMA)
    for name in ("id", "doc", "runs", "kept", "score", "lang_pred", "node", "n_lines", "_id"):
        df = df.withColumn(name, df["H"])
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def query(spark, sf):
    from pairforge.llm.queries import QUERIES

    return lambda number: next(f for n, f in QUERIES.items() if n.startswith(f"op{number}_"))(spark, sf)
