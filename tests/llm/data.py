"""Small tables with the cases every operator has to stand."""

from __future__ import annotations

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names operators use themselves
        *(T.StructField(n, T.StringType()) for n in ("score", "print", "node", "part", "row", "size", "ids", "rank")),
    ]
)
LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 4_000
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (2, "ONE two three four five six seven", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, LONG, "la", "b"),
    (6, " \t\n\r ", "en", None),
    (7, "日本語のテキスト 12 <|endoftext|> ́é İ", "ja", "c"),
    (8, "!!! 123 ???", None, "a"),
    (9, "you are a stupid idiot, he said nothing", "en", "c"),
    (None, "no id here at all", "en", "a"),
]


def documents(spark, rows=ROWS):
    full = [(i, t, lang, s, len(t or ""), *(["x"] * 8)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return documents(spark, [])


def sample(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
