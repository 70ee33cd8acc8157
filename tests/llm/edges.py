"""A small documents table with every awkward case."""

LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(30_000))

ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None),
    (4, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (5, "The quick brown  fox jumps over the\nlazy dog near the river bank today.", "en", "b", 71),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (7, LONG, "en", "a", len(LONG)), (8, LONG + " end", "en", "a", len(LONG) + 4),
    (9, "12345 !!! 678", "de", "c", 13), (10, "x" * 50_000, "de", "c", 50_000),
    (11, "über straße größe \U0001F600 日本語 текст", "de", "c", 30), (None, "no key here", "fr", None, 11),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use inside.
CLASH = ["row", "node", "key", "mark", "band", "recipe", "words", "t", "n", "kept", "count", "a", "b", "cls"]


def documents(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
    return df
