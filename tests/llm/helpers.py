"""Small tables with the awkward cases that every operator has to stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "Long words wander. " * 4000
TEXTS = [
    (1, "The quick brown fox, it's 42!"), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, "one two  three \n four"),
    (7, "The quick brown fox, it's 42!"), (7, "The quick brown fox, it's 42!"), (8, "ΣΑΣ ǅ İ ﬁ é 한국어 😀‍👩 x\x1cy\x00\x7f"),
    (9, "<|endoftext|> in a text <|startoftext|>x"), (None, "no id here"), (10, "aaaa" * 700), (11, "trail "), (12, "a\xa0b c"),
]


def documents(spark: SparkSession, rows=TEXTS) -> DataFrame:
    """Documents with other columns whose names operators might use themselves."""
    wide = [(i, t, "x", "s", 0, 7, True, "t", 1.0, 3) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept boolean, "
                                       "task string, score double, id int")


def table(folder, name: str, df: DataFrame) -> str:
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
