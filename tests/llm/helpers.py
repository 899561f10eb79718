"""Odd rows that every operator over documents must take: see each operator's docstring."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, mix string, quality int"

LONG = " ".join(f"wordé{i % 977}" for i in range(30_000))


def odd_documents(spark):
    """Null id, text and source, empty and long texts, repeated rows, and clashing extra columns."""
    rows = [
        (1, "Hello there, this is a plain text of some ten words", "en", "a", None, 1.0, "x", 1),
        (2, None, "en", "a", None, None, None, None),
        (3, "", "en", None, 0, 2.0, "y", 0),
        (None, "a text without an id that is long enough to be shingled", "en", "b", 5, 1.0, "x", 1),
        (4, LONG, "en", "b", None, 1.0, "x", 1),
        (5, "same row", None, "a", 8, 1.0, "x", 1),
        (5, "same row", None, "a", 8, 1.0, "x", 1),
        (6, " \t\n", "en", "a", 3, 1.0, "x", 1),
        (7, "Hello there, this is a plain text of some ten words", "en", "a", None, 1.0, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def sf_documents(spark, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet")
