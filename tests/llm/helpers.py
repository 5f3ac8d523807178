"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing extra columns."""

LONG = " ".join(f"word{i % 97}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 0.5, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 0.5, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 0.5, "x"),
    (3, None, None, None, None, None),
    (4, "", "de", "b", 1.0, ""),
    (5, "   \n\t ", "de", "b", 1.0, ""),
    (6, "123 456 --", None, "b", None, "y"),
    (7, LONG, "fr", "c", 2.0, "z"),
    (8, "der schnelle braune Fuchs springt", "de", None, 2.0, "z"),
    (9, "Straße ▁ über \U0001f600 \x00 end", "de", "c", 2.0, "z"),
    (None, "no id at all", "en", "a", 0.1, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, digest string"


def documents(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(ROWS if rows is None else rows, schema)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
