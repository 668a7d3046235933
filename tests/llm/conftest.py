"""Documents that hold the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

WORDS = [f"w{i}" for i in range(60)]


def corpus() -> list[tuple]:
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage = text(40)
    base = text(120)
    rows = [(i, text(r.randrange(1, 90))) for i in range(30)]
    rows += [(100 + i, f"{text(20)}\n{passage}\t {text(15)}") for i in range(6)]
    rows += [(200 + i, base if i % 2 else base + f" tail{i}") for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (None, base), (None, None), (303, "one two"), (304, "one two"), (305, "one two"), (305, "one two")]
    rows += [(400, text(9000)), (401, "é" * 4000 + "  x"), (402, "a<|endoftext|>b")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    more = [(i, t, "en", 1, "c", 2, 3.5) for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, bucket int, block string, n_tokens int, score double").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
