"""Quality classification by co-training of two views.

The content view sees the text only: hashed words and shape statistics that
do not tell its length.  The metadata view sees source, language and the
stated length, never the text.  Both start from labelled documents; in each
round each view scores all unlabelled documents and gives its most confident
pseudo-labels to the other.  Then each view is calibrated on documents that
neither has learned from, and the calibrated views are combined by a logistic
line fitted there too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import mix, slices, pieces, stored, words
from .toxicity import held_out, logistic

#: Labelled documents of each class that are learned from, at most.
TRAIN_DOCS = 3000
#: Rounds, pseudo-labels of each class that a view gives in a round, and how sure of them it has to be.
ROUNDS, GIVEN, CONFIDENT = 4, 200, 0.95
#: A document is kept from this probability of good quality on.
KEEP = 0.5
#: Buckets of words, and of sources and languages.
WORDS, META = 128, 64


def text_view(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shape and hashed words of each text of a piece, a row each."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high, space, line = (data >= 48) & (data <= 57), data >= 0x80, data == 32, data == 10
    counts = [total(m) for m in (upper, lower, digit, high, space, line)]
    other = size - sum(counts)
    stops, bangs = total((data == 46) | (data == 44)), total(data == 33)
    start, end, row, h = words(data, bounds, "solid")
    k = np.bincount(row, minlength=n)
    width = np.bincount(row, end - start, n)
    long = np.bincount(row, end - start > 20, n)
    short = np.bincount(row, end - start <= 3, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row, same, n)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    times = np.diff(np.concatenate((np.flatnonzero(new), [len(h)]))) if len(h) else np.empty(0, int)
    top = np.zeros(n)
    np.maximum.at(top, row[order][new], times)
    two = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    inside = row[:-1] == row[1:] if len(h) > 1 else np.empty(0, bool)
    r2, g2 = row[: len(two)][inside], two[inside]
    o2 = np.lexsort((g2, r2))
    n2 = np.ones(len(g2), bool)
    n2[1:] = (g2[o2][1:] != g2[o2][:-1]) | (r2[o2][1:] != r2[o2][:-1])
    pairs = np.bincount(r2[o2][n2], minlength=n)
    tail = data[end - 1] if len(end) else np.empty(0, np.uint8)
    odd = np.bincount(row, ~((tail >= 48) & (tail <= 57) | (tail >= 65) & (tail <= 90) | (tail >= 97) & (tail <= 122) | (tail >= 0x80) | (tail == 46) | (tail == 44)), n)
    c, s = np.maximum(1, k), np.maximum(1, size)
    letters = np.maximum(1, counts[0] + counts[1])
    f = [counts[0] / letters, counts[2] / s, counts[3] / s, counts[4] / s, counts[5] / c, other / s, stops / s, bangs / c, width / c, long / c, short / c, again / c, distinct / c, top / c, pairs / c, odd / c]
    f = np.stack(f, 1).astype(np.float64)
    # the share of words in each bucket, as roots, so that common words do not drown the others
    bucket = (h >> np.uint64(40)).astype(np.int64) % WORDS
    bag = np.bincount(row * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    return np.hstack([f, f**2, np.sqrt(bag / c[:, None])]).astype(np.float32)


def meta_view(source, lang, n_chars) -> np.ndarray:
    """Hashed source and language, and the stated length; nulls are a value of their own."""
    out = np.zeros((len(source), META + 4), np.float32)
    for i, (a, b, n) in enumerate(zip(source, lang, n_chars)):
        out[i, zlib.crc32(f"s{a}".encode()) % META] = 1
        out[i, zlib.crc32(f"l{b}".encode()) % META] += 1
        size = np.log1p(max(0, n or 0))
        out[i, META:] = size, size**2, n is None, size > 8
    return out


def _features(text: str, meta: list[str | None]):
    """A generator of (batch, content view, metadata view) for mapInArrow functions."""
    def each(batches):
        for b in slices(batches):
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist() if c else [None] * b.num_rows
            views = [text_view(data, bounds) for _, data, bounds in pieces(b.column(b.schema.get_field_index(text)))]
            yield b, np.vstack(views) if views else np.zeros((0, 32 + WORDS), np.float32), meta_view(*(get(c) for c in meta))

    return each


class _Scaled:
    """A logistic regression on standardised features, clipped so that odd texts stay in range."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.w, self.b = logistic(self.scaled(x), y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), ridge=1.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scaled(x) @ self.w + self.b, -20, 20)


def _trained(own: list) -> tuple[list[_Scaled], list]:
    """Both views as learned from their own examples, and the line that makes a probability of each one's logit."""
    views = [_Scaled(*o) for o in own]
    return views, [logistic(v.logit(o[0])[:, None], o[1], ridge=0.1) for v, o in zip(views, own)]


def sure(views: list, lines: list, xs) -> list[np.ndarray]:
    """Probability of good quality by each view."""
    return [1 / (1 + np.exp(-np.clip(v.logit(x) * a[0] + b, -30, 30))) for v, (a, b), x in zip(views, lines, xs)]


def cotrain(xt, xm, y, pool, prior: float, rounds: int = ROUNDS) -> dict:
    """Both views, trained on labelled (xt, xm, y) and on a pool of unlabelled documents, and their combination.

    ``pool(views, lines, taken)`` gives for each view and class the most
    confident documents that are not taken: (view, class, key, xt, xm).
    """
    if len(y) < 20 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 1.0}
    part = np.arange(len(y)) % 4 == 3  # for calibration only
    own = [(xt[~part], y[~part].astype(float)), (xm[~part], y[~part].astype(float))]
    taken: set = set()
    for _ in range(rounds):
        gifts = pool(*_trained(own), taken)
        if not gifts:
            break
        for view, label, _, *x in gifts:
            to = 1 - view
            own[to] = np.vstack([own[to][0], x[to][None]]), np.append(own[to][1], float(label))
        taken |= {key for _, _, key, *_ in gifts}
    views = [_Scaled(*o) for o in own]
    z = np.stack([v.logit(x[part]) for v, x in zip(views, (xt, xm))], 1)
    t = y[part].astype(float)
    share = min(max(t.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(t == 1, prior / share, (1 - prior) / (1 - share))
    platt = [logistic(z[:, k : k + 1], t, weight, ridge=0.1) for k in (0, 1)]
    each = np.stack([z[:, k] * platt[k][0][0] + platt[k][1] for k in (0, 1)], 1)
    return {"views": views, "platt": platt, "both": logistic(each, t, weight, ridge=0.5), "given": len(taken)}


def probability(model: dict, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good quality by both views, by the text, and by the metadata."""
    if "constant" in model:
        p = np.full(len(xm), model["constant"])
        return p, p, p
    each = np.stack([v.logit(x) * a[0] + b for v, x, (a, b) in zip(model["views"], (xt, xm), model["platt"])], 1)
    of = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return of(each @ model["both"][0] + model["both"][1]), of(each[:, 0]), of(each[:, 1])


def _pool(features: DataFrame, given: int, width: tuple[int, int]):
    """The pool of cotrain() over a stored table (key, t, m) of all unlabelled documents.

    A round is one pass: each task gives its ``given`` most confident ones of
    each view and class, and of these the most confident of all are taken.
    Ties go by a hash of the key, then the key.
    """
    spark = features.sparkSession

    def pool(views, lines, taken):
        shared = spark.sparkContext.broadcast((views, lines, taken))

        def run(batches):
            views, lines, taken = shared.value
            best: dict[tuple[int, int], list] = {(v, y): [] for v in (0, 1) for y in (0, 1)}
            for b in batches:
                x = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(b.num_rows, w) for c, w in zip(("t", "m"), width)]
                keys, tie = b.column("key").to_pylist(), b.column("tie").to_pylist()
                for v, p in enumerate(sure(views, lines, x)):
                    for y, q in ((1, p), (0, 1 - p)):
                        least = -best[v, y][-1][0] if len(best[v, y]) == given else 0.0
                        found = [(-float(q[i]), tie[i], keys[i]) for i in np.flatnonzero(q >= max(CONFIDENT, least)).tolist() if keys[i] not in taken]
                        best[v, y] = sorted({*best[v, y], *found})[:given]
            rows = [(v, y, *r) for (v, y), rs in best.items() for r in rs]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))], names=["v", "y", "p", "tie", "key"])

        found = features.mapInArrow(run, "v int, y int, p double, tie bigint, key bigint").dropDuplicates(["v", "y", "key"]).persist()
        chosen = [(v, y, r.key) for v in (0, 1) for y in (1, 0) for r in found.where((F.col("v") == v) & (F.col("y") == y)).orderBy("p", "tie", "key").limit(given).collect()]
        found.unpersist()
        shared.destroy()
        if not chosen:
            return []
        keys = F.broadcast(spark.createDataFrame(sorted({(k,) for *_, k in chosen}), "key bigint"))
        x = {r.key: (np.frombuffer(r.t, np.float32), np.frombuffer(r.m, np.float32)) for r in features.join(keys, "key").dropDuplicates(["key"]).collect()}
        return [(v, y, k, *x[k]) for v, y, k in chosen]

    return pool


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", meta=("source", "lang", "n_chars"), per_class: int = TRAIN_DOCS) -> dict:
    """The model, from a bounded sample of labelled documents outside the held-out fold and, without labels, from all others.

    Labelled are documents whose id has a label of 0 or 1 (the smaller one, if
    it has both); the ``per_class`` rows with the smallest hashes are learned
    from.  All documents with other ids, or none, are unlabelled here, as a
    label that is not in the sample is not looked at.  Equal rows count once.
    The features of unlabelled documents are stored once, so that a round does
    not read texts again, and nothing but samples is shuffled.
    """
    meta = [c if c in docs.columns else None for c in meta]
    i = F.col(doc_id).alias("i")
    known = labels.select(i, F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out(F.col("i"))).groupBy("i").agg(F.min("y").alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    cols = [c for c in dict.fromkeys([text, *meta]) if c]
    order = F.xxhash64("i", F.lit(6))
    some = [known.where(F.col("y") == v).orderBy(order, "i").limit(per_class) for v in (0, 1)]
    seen = docs.select(i, *cols).join(F.broadcast(some[0].union(some[1])), "i").withColumn("key", F.xxhash64("i", *cols))
    free = docs.select(i, *cols).join(F.broadcast(some[0].union(some[1]).select("i")), "i", "left_anti").withColumn("key", F.xxhash64("i", *cols)).withColumn("y", F.lit(-1))
    each = _features(text, meta)

    def run(batches):
        for b, xt, xm in each(batches):
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("key")), b.column(b.schema.get_field_index("y")), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (xt, xm))], names=["key", "y", "t", "m"])

    found = lambda df: df.select("key", "y", *cols).mapInArrow(run, "key bigint, y int, t binary, m binary").withColumn("tie", F.xxhash64("key", F.lit(6)))
    rows = found(seen).dropDuplicates(["key"])
    got = [r for v in (0, 1) for r in rows.where(F.col("y") == v).orderBy("tie", "key").limit(per_class).collect()]
    got.sort(key=lambda r: (r.tie, r.key))
    y = np.array([r.y for r in got])
    if len(got) < 20 or y.min() == y.max():
        return cotrain(None, None, y, None, 0.5)
    xt, xm = (np.frombuffer(b"".join(x), np.float32).reshape(len(got), -1) for x in ([r.t for r in got], [r.m for r in got]))
    pool = _pool(stored(found(free).drop("y"), "features"), GIVEN, (xt.shape[1], xm.shape[1]))
    prior = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    return cotrain(xt, xm, y, pool, min(max(prior, 0.01), 0.99))


def score(docs: DataFrame, model: dict, text: str = "text", meta=("source", "lang", "n_chars"), keep_text: bool = True, keep: float = KEEP) -> DataFrame:
    """Columns of ``docs`` with quality, quality_text, quality_meta (probabilities) and kept.

    Every row and whole text is scored, very long ones too, about a megabyte
    at a time; repeated rows stay and get equal scores.  Null texts count as
    empty ones; null or absent metadata is a value of its own.  Without usable
    labels the probability is their share of good ones, or 1 where there are
    none.  A probability of exactly ``keep`` keeps.  An empty table gives an
    empty one.  Columns of ``docs`` with the names of results are replaced.
    """
    made = ("quality", "quality_text", "quality_meta", "kept")
    base = docs.drop(*made)
    meta = [c if c in base.columns else None for c in meta]
    stay = [c for c in base.columns if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    each = _features(text, meta)

    def run(batches):
        for b, xt, xm in each(batches):
            p = probability(shared.value, xt, xm)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in stay), *map(pa.array, p)], names=[*stay, *made[:3]])

    fields = T.StructType([base.schema[c] for c in stay])
    for c in made[:3]:
        fields = fields.add(c, "double")
    return base.mapInArrow(run, fields).withColumn("kept", F.col("quality") >= keep)
