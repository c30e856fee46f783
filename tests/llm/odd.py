import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, copies int, chunk int, slot int, bits string, "
          "mask string, print string, sha string, `maybe` string, key string, quality_score string, text_to_score string, pattern string, "
          "rows string, passes int, place string, removed string, gone_id string, verdict_id string")


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and equal texts, under clashing column names."""
    words = [f"w{i}" for i in range(400)]
    clean = " ".join(words)
    texts = [
        (0, clean), (1, clean), (2, clean + " tail"), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "ONE two"),
        (8, " ".join(words[:200])), (9, "x" * 300_000), (10, "é ß 字 " * 50), (11, "a b c d e"), (12, "a b c d e"), (12, "a b c d e"),
        (None, "a b c d e"), (None, None), (13, "\n".join(["the same line of text that repeats here again"] * 6)), (14, "<|endoftext|> a  b\n c"),
        (15, "word " * 30_000), (16, "o n e t w o"),
    ]
    return [(i, t, "en" if (i or 0) % 3 else None, [None, "s", "t"][(i or 0) % 3], None, "s", 7, 8, 9, *["x"] * 8, *["y"] * 2, 3, *["z"] * 4)
            for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
