"""Classifiers and packing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import packing, quality, toxicity
from quillon.llm.text import pieces

BAD = ["vilethug", "scumbag", "wretchoid"]


def world(prose, n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        w = prose(rng.randint(20, 120), seed * 10000 + i).split()
        if not good:
            w = [w[0]] * len(w) if rng.random() < 0.5 else [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "", "s", "er"])
        rows.append((i, " ".join(w), good, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark, prose):
    rows = world(prose)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t)) for i, t, _, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (9999, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels, rows


def test_toxicity_on_held_out_documents(tables, make):
    docs, labels, rows = tables
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i, *_ in rows if got[i].held_out]
    assert 40 < len(held) < 140
    assert sum(got[i].predicted == rows[i][3] for i in held) >= 0.93 * len(held)
    odd = make([None, "", "!!!", "vilethugg zz", "clean " * 30000, "é"])
    score = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert score[0] == score[1] == score[2] == 0 and score[3] > 0.5 > score[4]  # a misspelling that was never seen
    assert toxicity.score(make([]), model).count() == 0


def test_toxicity_without_labels(tables, spark):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def test_labels_of_the_held_out_fold_are_not_used(tables):
    docs, labels, _ = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a["table"] == b["table"]).all() and (a["scale"], a["shift"]) == (b["scale"], b["shift"])


def test_bags_do_not_depend_on_neighbours():
    one, cut = toxicity.bags(["abc"])
    many, bounds = toxicity.bags(["x", "abc", "éé"])
    assert sorted(one[cut[0] : cut[1]]) == sorted(many[bounds[1] : bounds[2]])
    assert len(one) == 3 + 2 + 1 + 1  # 3-, 4- and 5-grams of <abc>, and itself


def test_quality_on_held_out_documents(tables):
    docs, labels, rows = tables
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs.withColumn("kept", F.lit("clash")), model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i, *_ in rows if got[i].held]
    assert sum(got[i].kept == bool(rows[i][2]) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.quality <= 1 and 0 <= r.quality_meta <= 1 for r in got.values())


def test_quality_of_odd_rows(tables, spark):
    docs, labels, _ = tables
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 40000, "en", "s", -5), (None, "a", "x", "y", 1), (1, None, None, None, None)], docs.schema)
    assert quality.score(odd, model).count() == 5
    assert quality.score(odd.select("doc_id", "text"), model).count() == 5
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert all(r.kept for r in quality.score(docs, none).collect())


def test_cotraining_uses_the_other_view():
    """The text view's features are noise for what few labels there are of a kind that the metadata knows."""
    rng = np.random.default_rng(4)
    n, m = 60, 600
    y, u = rng.integers(0, 2, n), rng.integers(0, 2, m)
    text = lambda t: np.hstack([t[:, None] * 1.0 + rng.normal(0, 0.9, (len(t), 1)), rng.normal(size=(len(t), 6))])
    meta = lambda t: t[:, None] * 2.0 + rng.normal(0, 0.4, (len(t), 2))
    yt, ym, ut, um = text(y), meta(y), text(u), meta(u)

    def pool(views, lines, taken):
        out = []
        for v, p in enumerate(quality.sure(views, lines, (ut, um))):
            for label, q in ((1, p), (0, 1 - p)):
                best = [i for i in np.argsort(-q, kind="stable").tolist() if i not in taken and q[i] >= quality.CONFIDENT][: quality.GIVEN]
                out += [(v, label, i, ut[i], um[i]) for i in best]
        return out

    model = quality.cotrain(yt, ym, y, pool, 0.5)
    assert 0 < model["given"] <= m
    t = rng.integers(0, 2, 500)
    both, by_text, by_meta = quality.probability(model, text(t), meta(t))
    right = lambda p: ((p >= 0.5) == (t == 1)).mean()
    assert right(both) > 0.93 and right(both) >= right(by_text)
    assert right(by_text) > 0.6


def test_pool_gives_the_most_confident_of_all(spark):
    """Each round's pseudo-labels against a sort of all unlabelled rows, with ties and repeated rows."""
    rng = np.random.default_rng(6)
    xt, xm = rng.normal(size=(300, 3)).round(1).astype(np.float32), rng.normal(size=(300, 2)).round(1).astype(np.float32)
    key = list(range(1000, 1290)) + list(range(1000, 1010))
    xt[290:], xm[290:] = xt[:10], xm[:10]
    rows = spark.createDataFrame([(k, a.tobytes(), b.tobytes()) for k, a, b in zip(key, xt, xm)], "key bigint, t binary, m binary").withColumn("tie", F.xxhash64("key", F.lit(6))).repartition(5)
    y = (xt[:, 0] + rng.normal(0, 0.2, 300) > 0).astype(float)
    views, lines = quality._trained([(xt, y), (xm, (xm[:, 0] > 0).astype(float))])
    tie = {r.key: r.tie for r in rows.collect()}
    for given, taken in ((7, set()), (1000, set(key[:50]))):
        got = [(v, label, k) for v, label, k, *_ in quality._pool(rows, given, (3, 2))(views, lines, taken)]
        want = []
        for v, p in enumerate(quality.sure(views, lines, (xt, xm))):
            for label, q in ((1, p), (0, 1 - p)):
                best = sorted({(-float(x), tie[k], k) for x, k in zip(q, key) if x >= quality.CONFIDENT and k not in taken})
                want += [(v, label, k) for _, _, k in best[:given]]
        assert got == want and len(want) > 10


def test_score_is_that_of_the_most_toxic_word(tables, make):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    texts = ["a vilethugs b", "É x", "abc " * 3 + "scumbagger", "w" * 5000, "one", "One ONE one"]
    for i, r in enumerate(sorted(toxicity.score(make(texts), model).collect())):
        z = []
        for w in texts[i].split():  # each word by itself: the mean of its subwords' numbers
            flat, cut = toxicity.bags(["".join(c.lower() if "A" <= c <= "Z" else c for c in w)])
            assert cut.tolist() == [0, len(flat)]
            z.append(float(np.mean(model["table"][flat].astype(float))) + model["bias"])
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model["scale"] * max(z) + model["shift"]))), abs=1e-9)


def test_training_does_not_depend_on_partitions_or_repeated_rows(tables):
    docs, labels, _ = tables
    a, b = toxicity.train(docs, labels), toxicity.train(docs.union(docs).repartition(7), labels.union(labels))
    assert (a["table"] == b["table"]).all()
    c, d = (quality.train(x, labels) for x in (docs, docs.union(docs).repartition(7)))
    assert np.allclose(c["both"][0], d["both"][0])


def test_text_view_of_pieces_is_that_of_each_text():
    import pyarrow as pa

    texts = ["A b b b!", "", "é é\n\nz", "WORD " * 300, "x"]
    each = [v for _, d, b in pieces(pa.array(texts), 3) for v in quality.text_view(d, b)]
    whole = [v for _, d, b in pieces(pa.array(texts)) for v in quality.text_view(d, b)]
    assert np.allclose(each, whole) and np.isfinite(whole).all()


# packing


def check(rows, sizes, capacities):
    """Every token once, no bin over its capacity, each downsized."""
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert set(by_doc) == {i for i, n in sizes.items() if n}
    for i, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) == sizes[i]
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    for rs in bins.values():
        used = sum(r.length for r in rs)
        assert {(r.used, r.capacity) for r in rs} == {(used, min(c for c in capacities if c >= used))}
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
    return sum(rs[0].capacity for rs in bins.values())


def test_packing(make):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 5, 60, 64, 65, 200, rng.randint(1, 300)]) for i in range(300)}
    texts = ["w " * n for n in sizes.values()]
    texts[0], sizes[0] = None, 0
    df = make(texts).withColumn("bin", F.lit("clash"))
    for shard in (20000, 100):
        total = check(packing.best_fit(df, capacities=(16, 64, 128), shard=shard).collect(), sizes, (16, 64, 128))
        assert total <= 1.15 * sum(sizes.values())
    assert packing.best_fit(make([])).count() == 0
    twice = packing.best_fit(make(["a b"] * 2, ids=[1, 1])).collect()
    assert [r.length for r in twice] == [2, 2] and {r.used for r in twice} == {4}


def test_shards_of_few_long_documents(spark):
    docs = spark.createDataFrame([(i, "", 20_000) for i in range(4)] + [(9, "", 3)], "doc_id bigint, text string, n bigint")
    rows = packing.best_fit(docs, capacities=(16, 32), shard=100, length=F.col("n")).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 2501 and sum(r.length for r in rows) == 80_003
    assert len(sizes) == 26 and max(sizes.values()) < 160


def test_best_fit_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        sizes = sorted(rng.sample(range(4, 40), 3))
        lengths = [rng.randint(1, sizes[-1]) for _ in range(rng.randint(1, 30))]
        bins, final, used = packing.pack(lengths, sizes, 2)
        load = [0] * len(final)
        for b, n in zip(bins, lengths):
            load[b] += n
        assert load == used and all(c == min(s for s in sizes if s >= u) for c, u in zip(final, used))
        # every policy, by a plain search over all open bins
        costs = []
        least = [min(s for s in sizes if s >= n) if n <= sizes[-1] else 0 for n in range(sizes[-1] + 1)]
        fair = [min((s for s in sizes if s >= n), key=lambda s: ((s + 2) / (s // max(1, n) * max(1, n)), -s)) for n in range(sizes[-1] + 1)]
        for opens in [[max(s, x) for x in least] for s in sizes] + [fair]:
            room, full = [], []
            for n in sorted(lengths, reverse=True):
                fits = [(r, i) for i, r in enumerate(room) if r >= n]
                if not fits:
                    room.append(opens[n])
                    full.append(opens[n])
                    fits = [(opens[n], len(room) - 1)]
                room[min(fits)[1]] -= n
            costs.append(sum(least[f - r] + 2 for f, r in zip(full, room)))
        assert sum(final) + 2 * len(final) == min(costs)
