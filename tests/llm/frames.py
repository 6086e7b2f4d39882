"""Small documents tables with the awkward rows that every operator must bear."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # extra columns, some of names that operators use themselves
        T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
    ]
)

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z")


def awkward(rng: random.Random) -> list[tuple]:
    """Null, empty and very long texts, ties, repeated rows, null ids and sources."""
    long_text = prose(rng, 30_000)
    same = prose(rng, 30)
    return [
        row(1, None), row(2, ""), row(3, " \t\n"), row(4, "one"), row(5, "!!! ---"), row(6, long_text, source=None), row(7, "x" * 300_000),
        row(8, same), row(9, same), row(9, same), row(None, same, source=None), row(10, None, None, None), row(11, "é ß 漢字 𝒳 ñ", None, "b"),
    ]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
