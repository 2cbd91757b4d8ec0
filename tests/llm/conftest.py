import random

import pytest

SCHEMA = "doc_id long, text string, lang string, fp int, score string, key string, spans string, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, copies, shared passages."""
    rng = random.Random(5)
    passage, other, long = prose(rng, 120), prose(rng, 70), prose(rng, 30_000)
    texts = [
        (1, "a b"), (2, None), (3, ""), (4, " \t\n "), (None, passage), (None, None), (5, f"{prose(rng, 30)} {passage}"),
        (6, f"{passage} {prose(rng, 9)} {passage}"), (7, long), (8, f"x{long}\n{other}"), (9, other), (9, other), (9, prose(rng, 55)),
        (10, f"{other[1:]} end"), (11, "word " * 400), (12, "w" * 70_000), (13, f"{prose(rng, 20)}  {passage.upper()}"), (14, "é" * 900), (15, "č" * 900),
        (16, "\x1c\x85 <|endoftext|> İΣ　x" * 3), (2**40, passage.replace(" ", "\t")), (-3, f"{prose(rng, 3)} {other}"),
    ]
    return [(i, t, "en", 1, "s", "k", "z", "r") for i, t in texts]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 17)] + [(3, 0, 0), (None, 1, 0), (4, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def texts(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
