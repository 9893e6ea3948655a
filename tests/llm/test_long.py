"""Very long texts, plans and bounds."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, license_scan, line_dedup, packing, quality, secret_scan, text, toxicity, url_filter


def test_lines_of_a_long_text(make):
    own = "\n".join(f"own {i}" if i % 2 else f"both {i % 900}" for i in range(200_000))
    began = time.monotonic()
    rows = {r.doc_id: r for r in line_dedup.dedup(make([own, own.replace("own", "OWN "), "both 0"]), min_docs=2).collect()}
    assert time.monotonic() - began < 60
    assert [(rows[i].n_lines, rows[i].n_dropped) for i in range(3)] == [(200_000, 100_000), (200_000, 100_000), (1, 1)]
    assert rows[0].kept_text == "\n".join(f"own {i}" for i in range(1, 200_000, 2)) and rows[2].kept_text == ""


def test_lines_beside_clashing_columns(spark):
    names = ("doc_id", "text", "h1", "h2", "d1", "d2", "row", "gone", "pos", "key", "n_docs", "n_lines", "a.b")
    df = spark.createDataFrame([(1, "x\ny", *range(11)), (2, "x\nz", *range(11)), (2, "x", *range(11)), (None, None, *range(11))], list(names))
    out = line_dedup.dedup(df, min_docs=3)
    assert out.columns == [n for n in names if n != "n_lines"] + ["n_lines", "n_dropped", "kept_text"]
    got = sorted((r.doc_id or 0, r.kept_text, r.n_lines, r.n_dropped, r.h1, r["a.b"]) for r in out.collect())
    assert got == [(0, "", 1, 0, 0, 10), (1, "y", 2, 1, 0, 10), (2, "", 1, 1, 0, 10), (2, "z", 2, 1, 0, 10)]


def test_secrets_of_long_texts(make):
    rng = random.Random(3)
    run = "".join(rng.choice(secret_scan.STATES) for _ in range(1_000_000))
    many = " ".join(f"token={i:012d} x" for i in range(100_000))
    began = time.monotonic()
    out = {r.doc_id: r for r in secret_scan.scan(make([run, many])).select("doc_id", F.size("base").alias("n"), F.element_at("spans", -1).alias("last")).collect()}
    assert time.monotonic() - began < 60
    assert (out[0].n, out[0].last.start, out[0].last.end, out[0].last.kind) == (0, 0, 1_000_000, "random")
    assert out[1].n == 100_000 and many[out[1].last.start : out[1].last.end] == "token=000000099999"


def test_random_spans_against_plain_python(make, prose):
    table, k = secret_scan.train(), len(secret_scan.STATES)
    rng, texts = random.Random(9), []
    for i in range(40):
        words = prose(30, i).split()
        for _ in range(4):
            words[rng.randrange(30)] = rng.choice(["".join(rng.choice(secret_scan.STATES) for _ in range(rng.randint(18, 40))), "_".join(rng.choice(secret_scan.PARTS) for _ in range(4)), "é" * 25])
        texts.append(" ".join(words))
    for r in secret_scan.scan(make(texts)).collect():
        want, t = [], texts[r.doc_id]
        import re

        for m in re.finditer(secret_scan.RUN, t):
            codes = [secret_scan.STATES.index(c) for c in m[0]]
            if sum(table[a * k + b] for a, b in zip(codes, codes[1:])) >= secret_scan.LEAST * (len(codes) - 1):
                want.append(m.span())
        assert [(p.start, p.end) for p in r.spans if p.kind == "random"] == want
    sums = make(["x"]).select(*(secret_scan.running_sums(F.lit(list(range(n))).cast("array<bigint>")).alias(f"n{n}") for n in (0, 1, 2, 7, 64, 100))).first()
    assert [x for x in sums] == [np.cumsum(range(n)).tolist() for n in (0, 1, 2, 7, 64, 100)]


def test_benchmark_blocks_take_one_pass(spark, make, monkeypatch):
    bench = spark.createDataFrame([(i, f"q{i} a b c d e f g h") for i in range(6)], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    out = decontaminate.scan(make(["x q3 a b c d e f g h y", "q5 a b c d e f g"]).withColumn("spans", F.lit(1)), bench, clean=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0]["items"] == ["0", "1", "2", "3", "4", "5"] and rows[0].clean_text == "x  y" and rows[1]["items"] == ["5"]


def test_windows_with_one_hash_are_told_apart(spark, make, monkeypatch):
    real = decontaminate.grams
    monkeypatch.setattr(decontaminate, "grams", lambda h, row, k: (real(h, row, k)[0] % np.uint64(2), real(h, row, k)[1]))
    known = decontaminate._windows([("a", "one two three"), ("b", "four five six seven"), ("a", "four five six seven"), ("c", "one"), ("d", "")], 3)
    got = decontaminate._looked(pa.array(["x one two three", "FOUR five six", None, "one", "six seven"]), [type("Block", (), {"value": known})()])
    assert {lo + i: sorted(who) for lo, part in got for i, who in part.items.items()} == {0: ["a", "c"], 1: ["a", "b"], 3: ["c"]}
    assert [part.spans(i) for _, part in got for i in range(5)] == [[(1, 4)], [(0, 3)], [], [(0, 1)], []]


def test_tables_of_a_block_are_small():
    rng = np.random.default_rng(1)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 50_000, 1000))) for i in range(300)]
    known = decontaminate._windows(items, 8)
    size = sum(x.nbytes for t in known["by"].values() for x in t) + known["start"].nbytes + known["end"].nbytes + len(known["low"])
    assert size < 40 * 300_000 + (1 << _bits())


def _bits():
    return decontaminate._BITS


def test_licence_chains_against_all_chains():
    rng = random.Random(5)
    for _ in range(300):
        places = []
        for _ in range(rng.randint(1, 9)):
            a, n, at = rng.randrange(25), rng.randint(1, 4), rng.randrange(12)
            places.append((a, a + n, at + n))
        got = max(license_scan._best(places))[0]

        def longest(i, order):  # by plain recursion
            a, b, at = order[i]
            best = b - a
            for j in range(i):
                gain = min(b - max(a, order[j][1]), at - order[j][2])
                if order[j][1] >= a - license_scan.MAX_GAP and gain > 0:
                    best = max(best, longest(j, order) + gain)
            return best

        order = sorted(set(places), key=lambda p: (p[1], p[2]))
        assert got == max(longest(i, order) for i in range(len(order)))


def test_edited_copies_of_licences(make):
    texts = license_scan.load()
    rng, docs, want = random.Random(8), [], []
    for label, templates in texts.items():
        for t in templates:
            w = t.split()
            if len(w) < 30:
                continue
            for _ in range(len(w) // 30):
                w[rng.randrange(5, len(w))] = "zzz"
            docs.append("see below " + " ".join(w) + " and so on")
            want.append(label)
    docs += [f"you can redistribute it under {'x ' * 40}", "the software is " * 2000]
    rows = {r.doc_id: r for r in license_scan.scan(make(docs)).collect()}
    for i, label in enumerate(want):
        assert label in {c.label for c in rows[i].covered}, (label, docs[i])
    assert not rows[len(want)].covered
    gpl2 = "either version 2 of the license or at your option any later version"
    notice = next(t for t in texts["gpl-2"] if gpl2 in t)
    assert {c.label for c in license_scan.scan(make([notice])).first().covered} == {"gpl-2"}
    assert license_scan.scan(make(["under the mit license"]), base={}, templates={}).first().score == 0
    assert license_scan.scan(make(["a b c d x"]), base={}, templates={"t": ["a b c d"]}).first().score == 1


def test_url_vocabulary_and_ties(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("1 Bad\n0.5 so soft\n\n0.7 so\n")
    assert url_filter.load(str(tmp_path / "terms.txt")) == {"bad": 1.0, "so": 0.7, "soft": 0.5}
    words = url_filter.load()
    assert len(words) > 60 and max(words.values()) == 1 and min(words.values()) < 0.5
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", "com", "/x/abc"), ("block", "com", "/x/abc")]
    df = spark.createDataFrame([("http://a.com/x", 1, 2), ("http://a.com/x", 1, 2), ("http://b.com/x/abcd", 3, 4), ("http://a.org/" + "a" * 100_000 + "/porn", 5, 6)], "url string, ruled int, row int")
    got = [(r.verdict, r.ruled, r.row) for r in url_filter.judge(df, rules=rules).collect()]
    assert got == [("block", 1, 2), ("block", 1, 2), ("allow", 3, 4), ("block", 5, 6)]


def test_nothing_is_left_set_or_behind(spark, make):
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    docs = make(["a b c d e f", None] * 3)
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    jaccard.join(docs).collect()
    quality.score(docs, quality.train(docs, labels)).collect()
    toxicity.score(docs, toxicity.train(docs, labels)).collect()
    license_scan.scan(docs).collect()
    assert before == (dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll()))
    text.release(spark, text.made())
    assert text.made() == []


def test_packing_of_odd_rows(spark, make):
    rows = packing.best_fit(make(["a " * 3000, "a " * 3000, None, "b"], ids=[None, None, 3, 4]), capacities=(8, 64)).collect()
    assert sum(r.length for r in rows) == 6001 and {r.doc_id for r in rows} == {None, 4}
    again = packing.best_fit(make(["b", "a " * 3000, None, "a " * 3000], ids=[4, None, 3, None]).repartition(4), capacities=(8, 64)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    with pytest.raises(TypeError):
        packing.best_fit(spark.createDataFrame([("x", "a")], "doc_id string, text string"))
