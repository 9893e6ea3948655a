import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts; ids are positions."""
    def run(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)

    return run


@pytest.fixture(scope="session")
def prose():
    """Made-up sentences."""
    def run(n, seed, vocabulary=400):
        rng = random.Random(seed)
        known = ["".join(rng.choice(["ba", "de", "lu", "mi", "on", "st", "ér"]) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
        return " ".join(rng.choice(known) for _ in range(n))

    return run
