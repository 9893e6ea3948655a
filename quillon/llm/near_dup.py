"""Exact near-duplicate links of vectors by dual traversal of cover trees.

Vectors of one label are scaled to length 1, so cosine >= c means a distance
of at most r = sqrt(2 - 2c).  Equal vectors are one row from the start.  The
top of the tree is a net of pivots that are far from each other, made from a
bounded sample; each vector belongs to its nearest pivot's cell, and also
visits those cells whose border (the plane between the two pivots) is within
r of it, as all others hold nothing near it.  In a cell, cover trees with
halving radii are built, one for its vectors and one for its visitors, and
traversed together: node pairs are pruned by their covering radii, and what
is left is compared exactly.  Labels that fit into one cell need no pivots.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .text import made, release, stored, whole_ids

COSINE = 0.98
#: Vectors of a cell, about, and numbers in them, at most; vectors of the sample that pivots come from; most pivots.
BLOCK, BLOCK_NUMBERS, SAMPLE, PIVOTS = 8192, 4 << 20, 8192, 2048
#: Allowance for rounding in bounds (never in the comparison itself).
SLACK = 1e-6
#: Rows that are compared with others at once; comparisons of which the hits are listed one by one.
STEP, FEW = 512, 4096


class Node:
    """A cover tree node: its centre, the rows below it, their largest distance, and its children."""

    __slots__ = ("centre", "rows", "radius", "children")

    def __init__(self, centre: int, rows: np.ndarray, radius: float) -> None:
        self.centre, self.rows, self.radius, self.children = centre, rows, radius, None


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _rounding(x: np.ndarray) -> float:
    """What a cosine of two rows may be off by in single precision; bounds allow for it, comparisons are in double."""
    return max(1e-5, 1.2e-7 * x.shape[1])


def _cover(x: np.ndarray, rows: np.ndarray, centre: int, level: float) -> list[Node]:
    """Nodes of at most this radius over the rows: centres are further apart than it, the given one is the first."""
    centres, whose, far = [centre], np.zeros(len(rows), np.int64), np.zeros(len(rows))
    eps = _rounding(x)
    reach = 1 - level * level / 2
    for lo in range(0, len(rows), STEP):
        part = rows[lo : lo + STEP]
        c = x[part] @ x[centres].T
        near = c.argmax(1)
        best = c[np.arange(len(part)), near].astype(np.float64)
        best[part == centre] = 2.0
        left = np.flatnonzero(best < reach)
        if len(left):  # a row that no centre covers is one, and may cover rows after it
            c = x[part[left]] @ x[part[left]].T
            np.fill_diagonal(c, 2.0)  # a centre is no distance from itself
            open_ = np.ones(len(left), bool)
            for i in range(len(left)):
                if open_[i]:
                    took = open_ & (c[i] >= reach)
                    near[left[took]], best[left[took]] = len(centres), c[i][took]
                    open_ &= ~took
                    centres.append(int(part[left[i]]))
        whose[lo : lo + STEP], far[lo : lo + STEP] = near, np.where(best >= 2.0, 0.0, np.sqrt(np.maximum(0.0, 2 - 2 * (best - eps))))
    order = np.argsort(whose, kind="stable")
    first = np.searchsorted(whose[order], np.arange(len(centres)))
    return [Node(c, r, float(f)) for c, r, f in zip(centres, np.split(rows[order], first[1:]), np.maximum.reduceat(far[order], first))]


def tree(x: np.ndarray, leaf: float) -> Node:
    """Nested levels over unit vectors: radii 1, 1/2, 1/4, ... down to ``leaf``; a node's centre is that of its first child."""
    x = x.astype(np.float32)
    root = Node(0, np.arange(len(x)), float(_distance(x[:1], x)[0].max()) + 10 * _rounding(x) ** 0.5)
    todo = [(root, 1.0)]
    while todo:
        node, level = todo.pop()
        if len(node.rows) <= 16 or node.radius <= leaf:
            continue
        while level >= node.radius:
            level /= 2
        node.children = _cover(x, node.rows, node.centre, level)
        todo += [(c, level / 2) for c in node.children if len(c.rows) > 1]
    return root


def _near(x: np.ndarray, ps: list[Node], y: np.ndarray, qs: list[Node], r: float, same: bool):
    """Pairs (i, j) of nodes that their radii do not rule out, part by part; of the same nodes i < j only."""
    cp, cq = np.array([k.centre for k in ps]), np.array([k.centre for k in qs])
    rp, rq = np.array([k.radius for k in ps], np.float32), np.array([k.radius for k in qs], np.float32)
    cols, wide, eps = y[cq], 1 << 20, _rounding(x)
    for lo in range(0, len(ps), STEP):
        for at in range(lo if same else 0, len(qs), wide):
            bound = r + rp[lo : lo + STEP, None] + rq[None, at : at + wide] if rp.any() or rq.any() else r
            near = x[cp[lo : lo + STEP]] @ cols[at : at + wide].T >= np.float32(1 - eps) - np.float32(0.5) * np.square(bound, dtype=np.float32) - np.float32(1e-6)
            if same and at == lo:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            yield i + lo, j + at


def traverse(x: np.ndarray, a: Node, y: np.ndarray, b: Node, r: float):
    """Pairs of row sets (rows of x, rows of y, each with each) that no covering radius rules out; once each.

    With x is y and a is b, each unordered pair of rows is in one of them:
    (rows, rows) with the same array stands for the pairs within it.  Pairs of
    single rows come together, as (rows, rows, True): each with its partner.
    """
    x, y = x.astype(np.float32), y.astype(np.float32)
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p is q and p.children is None:
            if len(p.rows) > 1:
                yield p.rows, p.rows, False
            continue
        if p is not q and p.children is None and q.children is None:
            yield p.rows, q.rows, False
            continue
        if p is q:
            ps = qs = p.children
            todo += [(k, k) for k in ps if len(k.rows) > 1]
        else:
            ps = p.children if p.children is not None and (q.children is None or p.radius >= q.radius) else [p]
            qs = q.children if ps == [p] else [q]
        one, two = np.array([len(k.rows) == 1 for k in ps]), np.array([len(k.rows) == 1 for k in qs])
        for i, j in _near(x, ps, y, qs, r, p is q):
            single = one[i] & two[j]
            if single.any():
                yield np.array([ps[k].centre for k in i[single]]), np.array([qs[k].centre for k in j[single]]), True
            todo += [(ps[m], qs[n]) for m, n in zip(i[~single].tolist(), j[~single].tolist())]


def _root(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = label[i]
    return i


def _roots(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = label[at]
        if (up == at).all():
            return up
        at = up


def links(x: np.ndarray, nx: np.ndarray, y: np.ndarray | None, ny: np.ndarray | None, cosine: float, trees: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links by row of x and of y (weighted by copies nx, ny), and a label joining the rows of both.

    y is None: pairs within x.  Rows of y are numbered after those of x.
    ``trees`` keeps the tree of x from one call to the next.
    """
    r = math.sqrt(2 - 2 * cosine)
    trees = {} if trees is None else trees
    if "x" not in trees:
        trees["x"] = tree(x, 1.25 * r)
    a = trees["x"]
    alone = y is None
    b, y2, n2 = (a, x, nx) if alone else (tree(y, 1.25 * r), y, ny)
    shift = 0 if alone else len(x)
    total = np.zeros(len(x) + (0 if alone else len(y)), np.int64)
    label = np.arange(len(total))

    def join(i: int, j: int) -> None:
        i, j = _root(label, i), _root(label, j)
        label[max(i, j)] = min(i, j)

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def count() -> None:
        """Links that were found pair by pair, many at once."""
        if held:
            p, q = map(np.concatenate, zip(*held))
            np.add.at(total, p, n2[q])
            np.add.at(total, q + shift, nx[p])
            for i, j in zip(p.tolist(), (q + shift).tolist()):
                join(i, j)
            held.clear()

    waiting = 0
    for p, q, matched in traverse(x, a, y2, b, r):
        if matched or len(p) * len(q) <= FEW:
            if matched:
                hit = np.einsum("ij,ij->i", x[p], y2[q]) >= cosine
                p, q = p[hit], q[hit]
            else:
                i, j = np.nonzero(x[p] @ y2[q].T >= cosine)
                if p is q:
                    i, j = i[i < j], j[i < j]
                p, q = p[i], q[j]
            held.append((p, q))
            waiting += len(p) + 16
            if waiting > 1 << 18:
                count()
                waiting = 0
            continue
        for lo in range(0, len(p), STEP):
            rows = p[lo : lo + STEP]
            hit = x[rows] @ y2[q].T >= cosine
            if p is q:
                hit &= rows[:, None] != q[None, :]
                total[rows] += hit @ nx[q]
            else:
                total[rows] += hit @ n2[q]
                total[q + shift] += hit.T @ nx[rows]
            full = np.flatnonzero(hit.any(1))
            for i, j in zip(rows[full].tolist(), (q[hit[full].argmax(1)] + shift).tolist()):
                join(i, j)
            for j in np.flatnonzero(hit.any(0)).tolist():
                join(int(rows[hit[:, j].argmax()]), int(q[j]) + shift)
            # hits between what the first ones of each row and column did not join
            of_rows, of_q = _roots(label, rows[full]), _roots(label, q + shift)
            i, j = np.nonzero(hit[full] & (of_rows[:, None] != of_q[None, :]))
            for i, j in np.unique(np.stack((of_rows[i], of_q[j]), 1), axis=0).tolist():
                join(i, j)
    count()
    while True:
        up = label[label]
        if (up == label).all():
            return total[: len(x)], total[len(x) :], label
        label = up


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(rows: DataFrame, wanted: int, sample: int) -> dict[int, np.ndarray]:
    """By dimension, centres far from each other, from a bounded sample by hash: each next one is the furthest."""
    by: dict[int, list] = {}
    for x in rows.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(sample).select("dim", F.col("e").cast("array<double>").alias("e")).collect():
        by.setdefault(x.dim, []).append(x.e)
    out = {}
    for dim, vs in by.items():
        x = _vectors(pa.array(vs, pa.list_(pa.float64())))
        far, chosen = _distance(x[:1], x)[0], [0]
        while len(chosen) < min(wanted, len(x)):
            nxt = int(far.argmax())
            if far[nxt] <= 1e-3:
                break
            chosen.append(nxt)
            far = np.minimum(far, _distance(x[nxt : nxt + 1], x)[0])
        out[dim] = x[chosen]
    return out


def cells(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each unit vector, and pairs (row, cell) of the visits it pays to cells after its own.

    Two vectors within r in cells a < c: the first is no further than r from
    the plane between the pivots of a and c, as the second lies beyond it.
    """
    cosines = x @ pivots.T
    own = cosines.argmax(1)
    gap = _distance(pivots, pivots)[own]
    visit = (cosines[np.arange(len(x)), own][:, None] - cosines) <= (r + SLACK) * gap + SLACK
    visit &= np.arange(len(pivots))[None, :] > own[:, None]
    return own, *np.nonzero(visit)


def pairs(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors link when their labels are equal and not null, their dimensions
    are equal and their cosine in double precision is at least ``cosine`` (a
    tie is a link).  Null, empty and zero vectors and those with null or
    non-finite components link with nothing.  A row is a vector, whatever its
    id: repeated rows link with each other, and so do different vectors of one
    id.  component_id is the smallest vec_id reachable by links, null where
    none of them has an id, and the own id of a vector that links with
    nothing; kept is whether it is the vector's own id (null with null, too).
    Ids are whole numbers; other types are an error.  An empty table gives an
    empty one; other columns are left out, whatever their names.
    """
    whole_ids(vectors, vec_id)
    spark, r = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    base = base.withColumn("dim", F.when(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)), F.size("e")))
    base = base.withColumns({"h1": F.xxhash64("label", "e"), "h2": F.xxhash64(F.lit(9), "label", "e")})
    # a class of equal vectors is told by its hashes, and named by where it is stored
    some = (F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("e").alias("e"))
    reps = stored(base.where("dim is not null").groupBy("h1", "h2").agg(*some).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    kinds = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    most, dim = kinds.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    block = min(block, max(64, BLOCK_NUMBERS // dim))
    wanted = min(PIVOTS, math.ceil(most / block))
    sample = min(SAMPLE, 16 * wanted, BLOCK_NUMBERS // dim)
    shared = spark.sparkContext.broadcast(_pivots(reps, wanted, sample) if wanted > 1 else {})

    def place(batches):
        for b in batches:
            dims, vs = b.column(b.schema.get_field_index("dim")).to_numpy(), b.column(b.schema.get_field_index("e"))
            own, visits = np.zeros(len(dims), np.int64), [[] for _ in dims]
            for d in np.unique(dims):
                if d not in shared.value:  # no pivot has this dimension: one cell
                    continue
                pick = np.flatnonzero(dims == d)
                for lo in range(0, len(pick), STEP):
                    part = pick[lo : lo + STEP]
                    own[part], row, cell = cells(_vectors(vs.take(pa.array(part))), shared.value[d], r)
                    for i, c in zip(part[row].tolist(), cell.tolist()):
                        visits[i].append(c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(visits, pa.list_(pa.int64()))], names=[*b.schema.names, "cell", "visits"])

    body = ("rep", "n", "label", "dim", "e")
    key = ["label", "dim", "cell"]
    if wanted > 1:
        placed = stored(reps.select(*body).mapInArrow(place, T.StructType([reps.schema[c] for c in body]).add("cell", "long").add("visits", T.ArrayType(T.LongType()))), "cells")
        used = made()[-1:]
        there = placed.select(*body, "cell", F.lit(0).alias("side")).union(placed.select(*body, F.explode("visits").alias("cell"), F.lit(1).alias("side")))
        # a cell with more vectors than a block is cut into parts, and all pairs of parts of it are formed
        sizes = there.groupBy(*key).agg(F.ceil(F.count_if(F.col("side") == 0) / block).alias("parts"), F.ceil(F.count_if(F.col("side") == 1) / block).alias("others"))
        there = there.join(sizes.where("parts > 0"), key)
    else:
        one = F.lit(0).cast("long")
        there, used = reps.select(*body, one.alias("cell"), F.lit(0).alias("side"), (one + 1).alias("parts"), one.alias("others")), []
    part = F.when(F.col("side") == 0, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.col("parts") + F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.col("others"))))
    # the task (i, j) has part i of a cell as its own and part j as the others; a part alone is with the first visitors
    home, last = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.col("parts") + F.col("others") - 1
    own = F.transform(F.sequence(F.col("part"), F.greatest(last, F.col("part"))), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(0).alias("to")))
    other = F.transform(F.filter(home, lambda i: i < F.col("part")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(1).alias("to")))
    # part i meets itself in the task of its first visitors, where there are any
    own = F.when(F.col("others") > 0, F.filter(own, lambda t: t["j"] != t["i"])).otherwise(own)
    tasks = F.when(F.col("side") == 0, F.concat(own, other)).otherwise(other)
    dealt = there.withColumn("part", part).withColumn("t", F.explode(tasks)).select(*key, "t.i", "t.j", "t.to", "parts", "rep", "n", "e")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("to", "ascending"), ("rep", "ascending")])
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        cut = int(np.searchsorted(table.column("to").to_numpy(), 1))
        x = _vectors(table.column("e").combine_chunks() if isinstance(table.column("e"), pa.ChunkedArray) else table.column("e"))
        i, j, parts = (int(table.column(c)[0].as_py()) for c in ("i", "j", "parts"))
        trees, out = {}, []
        if cut and j in (i, parts):
            a, _, joined = links(x[:cut], n[:cut], None, None, cosine, trees)
            out.append((rep[:cut], a, rep[:cut][joined]))
        if cut and cut < len(x):
            a, b, joined = links(x[:cut], n[:cut], x[cut:], n[cut:], cosine, trees)
            out.append((rep, np.concatenate((a, b)), rep[joined]))
        got = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
        some = got[1] > 0
        return pa.table([pa.array(c[some]) for c in got], names=["rep", "links", "root"])

    found = stored(dealt.groupBy(*key, "i", "j").applyInArrow(run, "rep bigint, links bigint, root bigint"), "links")
    release(spark, used)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = reps.select("h1", "h2", "rep", "least", "n").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("h1", "h2", "least", F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h1", "h2", "copies", "links", "component_id")
    # both sides of the last join are plain rows, so that those of a vector with very many copies are split
    out = base.select("vec_id", "dim", "h1", "h2").join(stored(named, "named"), ["h1", "h2"], "left")
    alone = F.col("dim").isNull() | F.col("copies").isNull()
    out = out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
