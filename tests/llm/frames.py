"""Small frames with the awkward cases: nulls in every column, empty and long texts, repeated rows,
ties, an empty table, and extra columns with names that operators use themselves."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, id long, kept string, word string, node long"
CLEAN = "The quick brown fox jumps over a lazy dog near the old river bank while seven small birds sing in green trees today"


def rows(texts) -> list[tuple]:
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, None, "x", 7, "no", "w", 1) for i, t in texts]


def frame(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame(rows(texts), SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [
        (1, CLEAN), (2, CLEAN.replace(" ", "  ")), (2, CLEAN.replace(" ", "  ")), (3, None), (4, ""), (5, " \t\n "),
        (6, long_), (7, long_ + " end"), (None, CLEAN), (None, None), (8, "ü 日本 x@y.de"), (9, "a\nb\na\n\n"),
    ]
    return frame(spark, texts)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [(0, "")]).where("false")
