import pytest
from pyspark.sql import DataFrame, SparkSession

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it goes home.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "The quick brown fox jumps over the lazy dog, and then it goes home.", "en"),
    (5, " \t\n  ", "fr"),
    (6, "word " * 30_000, "en"),
    (7, "x" * 50_000, "de"),
    (8, "Ünïcödé ▁ 梦 🙂\x00 <s> <|endoftext|> end\r\nnext\x85line", "de"),
    (8, "Ünïcödé ▁ 梦 🙂\x00 <s> <|endoftext|> end\r\nnext\x85line", "de"),
    (9, "12 34 56", None),
    (None, "A row without an id has a text all the same.", "en"),
]


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those the operators add."""
    rows = [(i, t, la, 0.5, "k", [1], "c") for i, t, la in ROWS]
    schema = "doc_id long, text string, lang string, score double, keys string, ids array<int>, text_to_map string"
    return spark.createDataFrame(rows, schema).repartition(3)


def rows_of(df: DataFrame, *names: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*names).collect()]
