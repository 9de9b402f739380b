import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, start=0, **more):
    rows = [(start + i, t, more.get("lang", "en"), "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def docs(spark):
    return lambda texts, **more: make_docs(spark, texts, **more)


@pytest.fixture
def prose():
    def make(seed, words=60, pool=400):
        rng = random.Random(seed)
        vocabulary = ["".join(random.Random(i).choices("abcdefghijklmnoprstuvwz", k=3 + i % 7)) for i in range(pool)]
        return " ".join(rng.choice(vocabulary) for _ in range(words))

    return make
