"""Small tables with the awkward rows every operator must handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHES = (
    "size score component_id keep_id kept hash doc n pos shingle target taken ids begins ends rule verdict host path page digest draw bin source_size length "
    "part text_sha256 group_size held_out predicted record_type payload chunk n_words words lines own_points decoded label license u v a b x y key"
).split()

LONG = " ".join(f"word{k % 977} tail{k % 613}" for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven old men walk along the river bank and talk about the weather"

TEXTS = [
    (1, PROSE, "en", "a"),
    (2, PROSE.replace("seven", "eight"), "en", "a"),
    (3, PROSE.upper() + "  ", "en", "b"),
    (4, "  " + PROSE.replace(" ", "\n"), None, "b"),
    (5, None, "en", "a"),
    (6, "", "en", None),
    (7, " \t\r\n", None, None),
    (8, LONG, "fr", "c"),
    (8, LONG, "fr", "c"),
    (None, PROSE, "en", "a"),
    (None, None, None, None),
    (9, "one two", "en", "a"),
    (10, "ONE  two", "en", "a"),
    (11, "été Ünïcode 日本語 🙂🙂 \x00 ###", "de", "d"),
    (12, PROSE + " " + PROSE, "en", "a"),
    (12, "another text under one id with ten words or so in it", "en", "a"),
    (13, PROSE, "en", "a"),
    (13, PROSE, "en", "a"),
]


def documents(spark: SparkSession, rows=None, parts: int = 3) -> DataFrame:
    """The rows with columns whose names operators use themselves."""
    found = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id bigint, text string, lang string, source string")
    found = found.withColumn("n_chars", F.length("text").cast("bigint"))
    return found.repartition(parts).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def empty(df: DataFrame) -> DataFrame:
    return df.where("1 = 0")
