"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character 3- to 5-grams (with its borders) and
itself, hashed into buckets; the mean of their embeddings goes through a
linear softmax.  Embeddings and softmax are trained together in numpy, on
words: as a document is toxic if a word of it is, a toxic document counts by
its most toxic word under the model so far, and words of clean documents are
clean.  A misspelt word shares most of its n-grams with the word that was
learned.  As mean and softmax are linear, scoring needs one number a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import mix, slices, pieces, powers, words

BUCKET_BITS, DIM, SIZES = 18, 8, (3, 4, 5)
#: Labelled documents that are learned from, at most, toxic and clean: those with the smallest hashes.
TRAIN_DOCS = (2500, 5000)
#: Bytes of their distinct words, at most: documents after that are not learned from.
TRAIN_BYTES = 48 << 20
#: One in so many of them is not learned from but calibrates the score.
CALIBRATE = 4
FOLDS, FOLD = 5, 0


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of words, and the bounds of each word's share."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + 1) - size  # of each word, after its border
    up, down = powers(len(codes))
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum((mix(codes.astype(np.uint64) + np.uint64(77)) | np.uint64(1)) * up[: len(codes)], out=total[1:])
    at, of, n_of = [], [], []
    for n in (*SIZES, 0):
        many = np.maximum(0, size + 3 - n) if n else np.ones(len(size), np.int64)
        word = np.repeat(np.arange(len(size)), many)
        at.append(np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + start[word] - 1)
        of.append(word)
        n_of.append(np.full(len(word), n, np.int64) if n else size + 2)
    at, of, n_of = np.concatenate(at), np.concatenate(of), np.concatenate(n_of)
    order = np.argsort(of, kind="stable")
    at, n_of = at[order], n_of[order]
    h = mix((total[at + n_of] - total[at]) * down[at] + n_of.astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(size)))))
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), bounds


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, bounds[1:] - bounds[:-1]).reshape(-1, *[1] * (values.ndim - 1))


def _all_bags(texts: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """bags() of many words, part by part, in less memory."""
    flat, bounds, at = [], [np.zeros(1, np.int64)], 0
    for lo in range(0, len(texts), step):
        f, b = bags(texts[lo : lo + step])
        flat.append(f.astype(np.int32))
        bounds.append(b[1:] + at)
        at += len(f)
    return np.concatenate(flat), np.concatenate(bounds)


def _values(table: np.ndarray, bias: float, flat: np.ndarray, bounds: np.ndarray, step: int = 20_000) -> np.ndarray:
    """The logit of each word, part by part."""
    return np.concatenate([_means(table[flat[bounds[lo] : bounds[min(lo + step, len(bounds) - 1)]]], bounds[lo : lo + step + 1] - bounds[lo]) for lo in range(0, len(bounds) - 1, step)]) + bias


class Model:
    """Embeddings and softmax; after ``finish`` one number a bucket."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.e = rng.normal(0, 0.3, (1 << BUCKET_BITS, DIM))
        self.v = rng.normal(0, 0.5, (DIM, 2))
        self.b = np.zeros(2)
        self.ge, self.gv = np.full(1 << BUCKET_BITS, 1e-2), np.full((DIM, 2), 1e-2)

    def learn(self, flat, bounds, pick, y, weight, rate: float) -> None:
        """One pass of Adagrad over the words ``pick``, in random order."""
        order = self.rng.permutation(len(pick))
        for lo in range(0, len(order), 1024):
            part = order[lo : lo + 1024]
            w, t, u = pick[part], y[part], weight[part]
            many = bounds[w + 1] - bounds[w]
            inst = np.repeat(np.arange(len(w)), many)
            idx = flat[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[w], many)]
            x = np.add.reduceat(self.e[idx], np.cumsum(many) - many, axis=0) / many[:, None]  # no word is without subwords
            z = x @ self.v + self.b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = (p - np.stack([1 - t, t], 1)) * u[:, None]
            dv, dx = x.T @ g, g @ self.v.T
            self.gv += dv**2
            self.v -= rate * dv / np.sqrt(self.gv)
            self.b -= rate * 0.1 * g.mean(0)
            de = (dx / many[:, None])[inst]
            by = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], idx[by][1:] != idx[by][:-1])))
            buckets, step = idx[by][first], np.add.reduceat(de[by], first, axis=0)
            self.ge[buckets] += (step**2).mean(1)
            self.e[buckets] -= rate * step / np.sqrt(self.ge[buckets])[:, None]

    def scalars(self) -> tuple[np.ndarray, float]:
        return self.e @ (self.v[:, 1] - self.v[:, 0]), float(self.b[1] - self.b[0])


def _top(z: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """The largest value of each document's words."""
    return np.array([z[i].max() for i in ids])


def fit(docs: list[tuple[list[str] | str, int]], rounds: int = 8, prior: float | None = None, seed: int = 11) -> dict:
    """Train on documents as their distinct words (a list, or joined by spaces) with labels.

    prior: share of toxic documents to calibrate for.
    """
    docs = [d for d in docs if d[0]]
    y = np.array([t for _, t in docs], int)
    if len(docs) == 0 or y.min() == y.max():
        return {"table": np.zeros(1 << BUCKET_BITS, np.float32), "bias": 0.0, "scale": 1.0, "shift": 4.0 if len(docs) and y[0] else -4.0}
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in (ws.split(" ") if isinstance(ws, str) else ws)], np.int32) for ws, _ in docs]
    del docs
    model = Model(seed)
    flat, bounds = _all_bags(list(vocab))
    # each class gives its share to calibration, as far as it has enough documents
    rank = np.zeros(len(y), int)
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum()) if (y == k).sum() >= 2 * CALIBRATE else 0
    learn = rank % CALIBRATE != CALIBRATE - 1
    toxic = [i for i, t, u in zip(ids, y, learn) if t and u]
    clean_docs = [i for i, t, u in zip(ids, y, learn) if not t and u]
    pos, neg = (np.bincount(np.concatenate(x), minlength=len(vocab)) for x in (toxic, clean_docs))
    # first each word by itself: as clean if a clean document has it
    seen = np.flatnonzero((pos >= 2) | (neg >= 1))
    for _ in range(3):
        model.learn(flat, bounds, seen, np.where(neg[seen] > 0, 0.0, 1.0), np.log1p(pos + neg)[seen], 0.3)
    clean = np.flatnonzero(neg > 0)
    for _ in range(rounds):
        table, bias = model.scalars()
        z = _values(table, bias, flat, bounds)
        # then toxic documents by their most toxic word that no clean one has, clean ones by all, hard ones twice
        own = np.where(neg > 0, -np.inf, z)
        chosen = np.array([i[own[i].argmax()] for i in toxic if np.isfinite(own[i]).any()], np.int64)
        hard = np.array([i[z[i].argmax()] for i in clean_docs], np.int64)
        target = np.concatenate((np.ones(len(chosen)), np.zeros(len(hard) + len(clean))))
        model.learn(flat, bounds, np.concatenate((chosen, hard, clean)), target, np.ones(len(target)), 0.2)
    table, bias = model.scalars()
    rest = ~learn if (~learn).any() else learn
    top = _top(_values(table, bias, flat, bounds), [i for i, u in zip(ids, rest) if u])
    t = y[rest].astype(float)
    share = t.mean() if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(t == 1, share / max(t.mean(), 1e-9), (1 - share) / max(1 - t.mean(), 1e-9))
    scale, shift = logistic(top[:, None], t, weight)
    return {"table": table.astype(np.float32), "bias": bias, "scale": float(max(scale[0], 1e-6)), "shift": float(shift)}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(a)) if weight is None else weight
    w, pen = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + pen * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def logits(model: dict, data, bounds) -> np.ndarray:
    """The largest word logit of each text of a piece; -inf without words."""
    start, end, row, h = words(data, bounds, "alnum")
    out = np.full(len(bounds) - 1, -np.inf)
    if not len(h):
        return out
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    low = data.tobytes().lower()
    flat, cut = bags([low[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist())])
    z = (_means(model["table"][flat], cut) + model["bias"])[back]
    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    out[row[edge]] = np.maximum.reduceat(z, edge)
    return out


def held_out(doc_id, folds: int = FOLDS, fold: int = FOLD):
    """crc32 of the id as text, modulo folds, is the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: tuple[int, int]) -> tuple[DataFrame, float]:
    """(i, y, text) of labelled documents outside the held-out fold, bounded per class, and the share of 1 among all.

    Labels without an id or a value are left out, an id with both is 1; rows
    of one id and text are one.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("i", F.lit(5))
    some = [known.where(F.col("y") == v).orderBy(order, "i").limit(m) for v, m in zip((1, 0), per_class)]
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(some[0].union(some[1])), "i")
    return rows.select("i", "y", "text"), n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: tuple[int, int] = TRAIN_DOCS) -> dict:
    """The model learned from at most ``per_class`` toxic and clean documents outside the held-out fold."""
    rows, share = sample(docs, labels, doc_id, text, label, per_class)

    def distinct(batches):
        for b in slices(batches):
            out = [""] * b.num_rows
            for lo, data, bounds in pieces(b.column(2)):
                start, end, row, _ = words(data, bounds, "alnum")
                low = data.tobytes().lower()
                own: dict[int, dict[bytes, None]] = {}
                for s, e, r in zip(start.tolist(), end.tolist(), row.tolist()):
                    own.setdefault(r, {})[low[s:e]] = None
                for r, ws in own.items():
                    out[lo + r] = b" ".join(ws).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["i", "y", "words"])

    # in an order that does not depend on partitions, classes mixed; rows beyond the bound stay where they are
    kind = rows.schema["i"].dataType.simpleString()
    found = rows.mapInArrow(distinct, f"i {kind}, y int, words string").distinct()
    found = found.withColumn("size", F.octet_length("words").cast("long"))
    order = F.xxhash64("i", F.lit(5))
    got, size = [], 0
    for r in found.orderBy(order, "i", F.xxhash64("words"), "words").limit(sum(per_class)).toLocalIterator():
        size += r.size
        if got and size > TRAIN_BYTES:
            break
        got.append((r.words, r.y))
    return fit(got, prior=share)


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` without the text, with held_out, score and predicted.

    Every whole text is scored, a very long one too, by the most toxic of its
    words; null and empty texts and those without words have score 0, and a
    score of exactly 0.5 is predicted as 1.  A null id counts as an empty text
    for held_out.  Rows stay as they are, repeated ones too, and get equal
    scores; an empty table gives an empty one.  Columns of ``docs`` with the
    names of results are replaced.
    """
    made = ("held_out", "score", "predicted")
    keep = [c for c in docs.columns if c != text and c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            z = np.full(b.num_rows, -np.inf)
            for lo, data, bounds in pieces(b.column(b.schema.get_field_index(text))):
                z[lo : lo + len(bounds) - 1] = logits(m, data, bounds)
            p = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(m["scale"] * np.where(np.isfinite(z), z, 0) + m["shift"], -500, 500))), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(p)], names=[*keep, "score"])

    out = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([docs.schema[c] for c in keep]).add("score", "double"))
    return out.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= 0.5).cast("int")})
