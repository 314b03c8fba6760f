import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null, empty, blank and very long texts, repeated rows, copies, odd characters."""
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 300_000, 50_000)
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "a b c d"), (5, "A b C D"), (6, "ünï çødé 漢字 \x1c <|endoftext|>   x"),
        (7, base), (8, base), (9, base.replace("w1", "W1")), (10, base + " tail of some more"), (11, long), (12, "x" * 300_000), (13, base), (13, base),
        (None, base), (None, None), (14, "line one\nline two\n\nline one"), (15, words(rng, 60)), (16, words(rng, 60)), (1 << 40, "big id"),
    ]
    return [(i, t, "en", None if i in (3, None) else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("id", "size", "label", "score", "ids", "node", "row", "copies", "n_lines", "shard", "rank", "line", "target"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3, "n_chars")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
