import pytest
from pyspark.sql import types as T

ROWS = "doc_id long, text string, lang string, source string, n_chars long, id string, kid int, th int, rest string, kept int, score string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns whose names operators use inside."""

    def make(rows, parts=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", 1, 2, "y", 3, "z") for r in rows]
        return spark.createDataFrame(full, T._parse_datatype_string(ROWS)).repartition(parts)

    return make


LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))

#: Nulls, empty and long texts, ties, repeated rows, rows without a key.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, LONG), (7, LONG),
    (8, "Größe ÄÖ\x00\x07 日本語 🎉\r\nTwo  words"), (9, "one\none\n\none"), (10, "a b c d e f g h " * 30),
]


@pytest.fixture(scope="session")
def edges(table):
    return table(EDGES)


@pytest.fixture(scope="session")
def nothing(table):
    return table(EDGES).where("false")
