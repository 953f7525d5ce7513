"""Rows that an operator must take: NULLs, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest " * 3

ROWS = [
    (1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN + "once", "en", "a"), (3, None, "en", "a"), (4, "", None, None),
    (5, LONG, "en", "b"), (6, "  \n\t ", "en", "b"), (7, "x", "en", None), (None, PLAIN, None, "a"), (None, None, None, None),
    (8, "Ünïcödé 漢字 🙂 don't I'll\n\nx  y <turn a> \\ </turn>", "de", "b"), (9, "12 34 !!", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use themselves.
CLASHES = ("row", "key", "label", "score", "host", "component_id", "kept", "sequence_id", "ids", "n", "shard", "words", "size")


def odd_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit("extra").alias(c) for c in CLASHES])


def no_docs(spark):
    return odd_docs(spark).limit(0)
