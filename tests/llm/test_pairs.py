"""Links of texts and of vectors against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard, near_dup

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def closure(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def sets_of(texts, k=5):
    out = []
    for t in texts:
        w = SOLID.findall(low(t))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def corpus(prose, seed, families=12, singles=15):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d", "a b c d e", "A b C d e", "É x", "é x"]
    common = prose(60, 999)
    for f in range(families):
        base = prose(rng.choice([6, 12, 40, 120, 300]), seed * 100 + f).split()
        for _ in range(rng.randint(2, 7)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(["zig", "zag", "zog"])
            texts.append(" ".join(w))
    texts += [prose(80, seed * 1000 + i) for i in range(singles)]
    texts += [common + " " + prose(rng.randint(2, 30), 5000 + i) for i in range(10)]
    texts += texts[10:13]
    return texts


@pytest.mark.parametrize("seed, block, piece", [(1, 3000, None), (2, 80, 400), (3, 3000, 200)])
def test_jaccard(make, prose, seed, block, piece, monkeypatch):
    if piece:
        real = jaccard.pieces
        monkeypatch.setattr(jaccard, "pieces", lambda c, limit=0: real(c, piece))
    if block < 3000:
        monkeypatch.setattr(jaccard, "HUBS", 2)
        block = 6
    texts = corpus(prose, seed)
    sets = sets_of(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = closure(len(texts), links)
    assert len(set(roots)) < len(texts) - 20
    df = make(texts).withColumn("id", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, block=block).collect())
    assert got == [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, roots))]


def test_jaccard_of_nothing_and_repeated_rows(make):
    assert jaccard.join(make([])).count() == 0
    rows = jaccard.join(make(["a b c d e f"] * 3 + [None], ids=[4, 4, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (7, 0, 7)]


def test_jaccard_of_the_same_texts_in_another_order(spark, make, prose):
    a, b, c = prose(40, 1), prose(50, 2), prose(45, 3)
    for order in ([a, b], [b, a]), ([a, b, c], [c, a, b]), ([a, b], [a, b]):
        texts = [t for part in order for t in part]
        both = spark.sparkContext.parallelize([(i, t) for i, t in enumerate(texts)], 2)
        assert [len(x) for x in both.glom().collect()] == [len(x) for x in order]
        got = sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(both, "doc_id bigint, text string")).collect())
        assert got == [(i, len(sets_of([t])[0]), texts.index(t)) for i, t in enumerate(texts)]


def test_jaccard_at_the_bound(make):
    words = [f"w{i}" for i in range(60)]
    for cut in range(1, 14):
        texts = [" ".join(words), " ".join(words[cut:]), " ".join(words[:-1])]
        sets = sets_of(texts)
        linked = 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1])
        n = np.array([len(s) for s in sets[:2]])
        code = {s: i for i, s in enumerate(sorted(sets[0] | sets[1]))}
        rows = [np.array(sorted(code[s] for s in x), np.uint64).tobytes() for x in sets[:2]]
        assert (jaccard.product(n, rows, 75).tolist() == [0, 0]) == linked


def test_large_component_by_parts(make, prose):
    base = prose(60, 77).split()
    texts = []
    for i in range(150):  # one family, in which most pairs link, and a second that shares its words only
        w = list(base)
        w[i % 60] = f"z{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:30] + [f"q{i}", f"r{i}"] + base[34:]) for i in range(30)]
    sets = sets_of(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = closure(len(texts), links)
    got = {r.doc_id: r.component_id for r in jaccard.join(make(texts), block=80).collect()}
    assert [got[i] for i in range(len(texts))] == want


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(seed, n=160, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.12, 0.3, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3)) if rng.random() < 0.9 else 1))
    rows += [(n, rows[3][1], rows[3][2]), (n + 1, rows[3][1], rows[3][2]), (n + 2, [2 * x for x in rows[3][1]], rows[3][2])]
    rows += [(n + 3, rows[5][1], None), (n + 4, None, 1), (n + 5, [0.0] * dim, 1), (n + 6, [None] + [1.0] * (dim - 1), 1), (n + 7, [float("nan")] + [1.0] * (dim - 1), 1), (n + 8, [float("inf")] + [1.0] * (dim - 1), 1)]
    rows += [(n + 9, [], 1), (n + 10, [1.0, 2.0], 1), (n + 11, [1.0, 2.0], 1), (n + 12, [1e-30] * dim, 1), (n + 13, [1e30] * dim, 1)]
    return rows


def brute_vectors(rows, cosine):
    ok = [e is not None and len(e) > 0 and None not in e and np.isfinite(e).all() and any(e) and label is not None for _, e, label in rows]
    unit = [np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float) / np.abs(e).max()) / np.abs(np.array(e, np.float32).astype(float)).max() if u else None for (_, e, _), u in zip(rows, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return [(rows[i][0], degree[i], rows[r][0], r == i) for i, r in enumerate(closure(len(rows), links))]


@pytest.mark.parametrize("seed, cosine, block", [(1, 0.98, 1024), (2, 0.98, 8), (3, 0.9, 16)])
def test_vectors(spark, seed, cosine, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_links", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in near_dup.pairs(df, cosine=cosine, block=block).collect())
    assert got == brute_vectors(rows, cosine)


def test_vectors_of_nothing_and_repeated_rows(spark):
    assert near_dup.pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = near_dup.pairs(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, None)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_vectors_of_null_and_repeated_ids(spark):
    e = lambda d: [float(v) for v in on_circle([d])[0]]
    rows = [(1, e(0), 0), (1, e(90), 0), (2, e(5), 0), (3, e(95), 0), (3, e(97), 0)]  # two vectors of id 1, in two groups
    got = sorted(tuple(r) for r in near_dup.pairs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]
    rows = [(None, e(0), 0), (None, e(0), 0), (5, e(1), 0), (None, e(180), 0), (None, e(181), 0), (None, None, 0)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_dup.pairs(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (0, 2, 5, False), (0, 2, 5, False), (5, 2, 5, True)]


def test_other_id_types_are_refused(spark, make):
    with pytest.raises(TypeError, match="bigint"):
        near_dup.pairs(spark.createDataFrame([("a", [1.0], 0)], "vec_id string, embedding array<float>, label int"))
    with pytest.raises(TypeError, match="bigint"):
        jaccard.join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert jaccard.join(spark.createDataFrame([(3, "b"), (2, "b")], "doc_id int, text string")).where("component_id = 2").count() == 2


@pytest.mark.parametrize("pivots", [2, 7, 40])
def test_cells_lose_no_pair(pivots):
    rng = np.random.default_rng(pivots)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, row, cell = near_dup.cells(x, x[rng.permutation(400)[:pivots]], 0.2)
    seen = set(zip(row.tolist(), cell.tolist()))
    for i, j in np.argwhere(near_dup._distance(x, x) <= 0.2).tolist():
        assert own[i] >= own[j] or (i, own[j]) in seen
    assert len(seen) < 0.4 * 400 * (pivots - 1)


@pytest.mark.parametrize("spread, block", [(0.02, 20), (0.2, 30), (0.2, 7)])
def test_vectors_of_a_dense_label(spark, spread, block):
    rng = np.random.default_rng(4)  # one group that no pivot splits, beside others
    x = np.concatenate((np.ones((90, 5)) + rng.normal(size=(90, 5)) * spread, rng.normal(size=(120, 5))))
    rows = [(i, [float(v) for v in e.astype(np.float32)], 1) for i, e in enumerate(x)]
    got = sorted(tuple(r) for r in near_dup.pairs(spark.createDataFrame(rows, SCHEMA), block=block).collect())
    assert got == brute_vectors(rows, 0.98)


def on_circle(degrees):
    a = np.radians(degrees)
    return np.stack((np.cos(a), np.sin(a)), 1)


def test_links_of_a_chain_in_one_leaf(spark):
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(on_circle([0, 30, 10, 20]))]
    got = sorted(tuple(r) for r in near_dup.pairs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_vectors(rows, 0.98) == [(0, 1, 0, True), (1, 1, 0, False), (2, 2, 0, False), (3, 2, 0, False)]


@pytest.mark.parametrize("cut", [None, 7])
def test_links_of_chains_in_any_order(cut):
    rng = np.random.default_rng(9)
    for n in (6, 12, 40, 300):
        for _ in range(20):
            x = on_circle(rng.permutation(n) * rng.choice([10.0, 4.0]) * 24 / n)
            one = np.ones(n, np.int64)
            k = n if cut is None else n * cut // 12
            a, b, label = near_dup.links(x[:k], one[:k], x[k:] if cut else None, one[k:] if cut else None, 0.98)
            hit = [(i, j) for i, j in np.argwhere(x @ x.T >= 0.98).tolist() if i > j and (cut is None or j < k <= i)]
            assert label.tolist() == closure(n, hit)
            assert a.tolist() + b.tolist() == np.bincount(np.array(hit, int).ravel(), minlength=n).tolist()


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 16)), 10, axis=0) + rng.normal(size=(300, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = near_dup.tree(x, 0.25)
    todo, leaves = [root], []
    while todo:
        n = todo.pop()
        d = near_dup._distance(x[n.centre : n.centre + 1], x[n.rows])[0]
        assert d.max() <= n.radius + 1e-6
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
            todo += n.children
        else:
            leaves.append(n)
    compared = sum(len(p) if matched else len(p) * len(q) for p, q, matched in near_dup.traverse(x, root, x, root, 0.2))
    assert compared < 0.15 * len(x) ** 2
