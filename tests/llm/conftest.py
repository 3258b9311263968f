import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""
    def build(*rows):
        return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows], SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties, repeated rows and ids."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return make((1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, None, None), (4, "", "y"), (None, "a b c d e f g", "y"),
                (None, None, "y"), (5, long, "x"), (6, long + " end", "z"), (7, " \n\t ", "y"), (8, "one", "y"), (9, "é ß 😀 one", "y"), (2, "another text", "x"), (10, "one", None))


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use."""
    from pyspark.sql import functions as F

    for name in ("keep_id", "kept", "cls", "mark", "node", "size", "shard", "item", "_text", "_id", "_length", "_key", "_gone", "sequence_id", "score", "target", "rank", "host"):
        odd = odd.withColumn(name, F.lit("clash"))
    return odd


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(7)
