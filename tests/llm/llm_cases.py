"""Inputs that every operator must handle: nulls, empty and long texts, ties, repeated rows and
extra columns whose names operators use themselves."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "A long text of many words, one after the other. " * 3000
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (4, "another text under the same number", "en", "b", 1),
    (None, "a text without a number, of more than five words", None, None, None),
    (None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)),
    (6, "Ünïcode wörds — “quoted” 中文 text\u00a0here <|endoftext|> $$$ \U0001f600!", "de", "c", 1),
]
CLASHES = ["h", "n", "node", "hash", "bucket", "row", "size", "position", "id", "words", "_hash", "part", "c"]


def edge_docs(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.withColumns({name: F.lit(7) for name in CLASHES})


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
