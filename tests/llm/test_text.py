"""Words, hashes and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.text import grams, pieces, sql_lower, words

SOLID, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["", None, "A b", "  x\ty\x0bz ", "É é ÉA\x85b\u00a0c", "a-b_C 9", "\x1c\x1dq", "one", "🙂x 🙂", "\n\n", "Straße STRASSE"]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("kind, pattern", [("solid", SOLID), ("alnum", ALNUM)])
@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_words(kind, pattern, limit):
    got = [[] for _ in TEXTS]
    by_hash = {}
    for lo, data, bounds in pieces(pa.array(TEXTS), limit):
        start, end, row, h = words(data, bounds, kind)
        for a, b, r, x in zip(start, end, row, h.tolist()):
            w = data[a:b].tobytes().lower().decode()
            got[lo + r].append(w)
            assert by_hash.setdefault(x, w) == w
    assert got == [pattern.findall(low(t)) for t in TEXTS]
    assert len(set(by_hash.values())) == len(by_hash)


def test_grams_stay_in_their_row():
    row = np.array([0, 0, 0, 1, 1])
    g, at = grams(np.arange(1, 6).astype(np.uint64), row, 2)
    assert at.tolist() == [0, 1, 3] and len(set(g.tolist())) == 3
    assert len(grams(np.arange(1, 3).astype(np.uint64), np.array([0, 0]), 3)[0]) == 0


def test_sql_lower(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(sql_lower(F.col("t"))).collect()] == [None if t is None else low(t) for t in TEXTS]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    up = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {i: r for i, r in up.items() if i != r}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
