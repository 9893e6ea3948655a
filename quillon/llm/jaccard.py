"""Exact n-gram Jaccard join by a blocked sparse product of the incidence matrix.

The matrix has a row per distinct shingle set (exact copies are one row) and
a column per shingle.  What would make its product with its transpose large
is cut away first, by bounds that lose no pair:

1. Columns with one row add nothing.  Shingles are dealt by hash in packed
   arrays and found to be shared or not; a shingle that occurs twice in one
   batch is known to be shared there and only a mark of it is dealt, so that
   a very common shingle is a few marks in its task.
2. A row with n shingles needs ceil(t * n) shared ones to reach similarity t
   with any other.  Most documents end here.
3. Rows that are similar share a shingle among the first n - ceil(t * n) + 1
   of each in any one order; here unshared ones come first, then rare ones.
   Components under "shares one of these" are the blocks of the product.
4. In a block, overlap counts are accumulated column by column for rare
   columns and as a dense product for frequent ones; pairs below the overlap
   that their sizes require are discarded.  A component of more than
   ``block`` rows is multiplied in parts (see _large).

Row ids are 64-bit sums of shingle hashes; among N different texts the
expected number of equal ids is N * N / 2**65 (0.03 for 10**9 texts).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .text import grams, mix, partitions, slices, pieces, stored, whole_ids, words

SHINGLE, PERCENT = 5, 75
#: Rows of one part of the product.
BLOCK = 3000
#: Rows of a large component that every part of it sees, in order to be connected early.
HUBS = 64
#: A batch is dealt once it has so many postings for each range of hashes, so that rows stay few; at most so many in all.
LEAST_IN_RANGE, MOST_POSTINGS = 32, 4_000_000
#: Documents of a batch, at most.
MOST_DOCS = 100_000
_ODD = 0x9E3779B97F4A7C15
#: Ids of sets that a task remembers, to deal each of them once.
SEEN = 200_000


def shingles(data, bounds, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of a piece, sorted by row, then hash."""
    _, _, row, h = words(data, bounds, "solid")
    g, at = grams(h, row, k)
    rows, hashes = [row[at]], [g]
    count = np.bincount(row, minlength=len(bounds) - 1) if len(row) else np.zeros(len(bounds) - 1, np.int64)
    for short in range(1, k):  # a text of fewer words is one sequence
        pick = count[row] == short if len(row) else np.zeros(0, bool)
        if pick.any():
            g, at = grams(h[pick], row[pick], short)
            rows.append(row[pick][at])
            hashes.append(g)
    row, g = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def _sets(data, bounds, k: int):
    """Rows, hashes, and by row the number of shingles and the id of the set."""
    row, g = shingles(data, bounds, k)
    n = np.bincount(row, minlength=len(bounds) - 1).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g + np.uint64(0x51ED27)))))
    return row, g, n, first, mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64)


def _needed(n, percent: int):
    return -(-percent * n // 100)


_DEALT = "k bigint, b bigint, counts binary, hashes binary, marks binary, ids binary, ns binary, often binary, marks_often binary, docs binary, nulls binary, of binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane: planes of small numbers are zeros, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _row(k: int, b: int, counts, hashes, marks=b"", ids=b"", ns=b"", often=b"", marks_often=b"", docs=b"", nulls=b"", of=b"") -> tuple:
    return int(k), int(b), _planes(counts), hashes.tobytes(), marks, ids, ns, often, marks_often, docs, nulls, of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 10]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _DEALT.split(", ")])


def _even_keys(spark, parts: int, each: int) -> np.ndarray:
    """For each of so many partitions some keys that Spark's hash sends to it, so that ranges are dealt evenly."""
    ids = spark.range(0, 40 * parts * each + 400).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("ids"))
    return np.array([x for r in ids.collect() for x in r.ids], np.int64)


def _deal(docs: DataFrame, doc_id: str, text: str, k: int, keys: np.ndarray) -> DataFrame:
    """Packed postings of batches b: to the task of a hash (k >= 0), or on the way home (k < 0).

    The home row of a batch has the ids and sizes of its sets, the ids of all
    documents with the place of the set of each, and the shingles that are
    known to be shared; a mark of each of these goes to the task of its hash.
    There, the number of postings and marks of a hash says how often it is, in
    a way that is the same for all rows.  A set that the task dealt before has
    no postings here: it is there for its documents only.
    """
    ranges = np.uint64(len(keys))
    enough = min(MOST_POSTINGS, LEAST_IN_RANGE * len(keys))

    def packed(row, g, own, n, doc, null):
        ids, of = np.unique(own, return_inverse=True)
        ns = np.zeros(len(ids), np.int64)
        ns[of] = n
        by_set = np.argsort(of[row], kind="stable")
        row, g = of[row][by_set], g[by_set]
        m, order = len(ids), np.argsort(g)
        same = np.zeros(len(g), bool)
        same[1:] = g[order][1:] == g[order][:-1]
        shared = np.zeros(len(g), bool)
        shared[order] = same
        shared[order[:-1]] |= same[1:]
        marks = np.unique(g[order][same])
        # postings name sets by their place among all of the batch, so a batch is told by its documents and their sets
        seed = mix(mix(own.view(np.uint64)) + mix(doc.view(np.uint64) + null) + np.arange(len(own), dtype=np.uint64) * np.uint64(_ODD))
        b = int(mix(np.array([seed.sum() + np.uint64(len(g))], np.uint64)).view(np.int64)[0])
        rows = [_row(-1 - keys[b % len(keys)], b, np.bincount(row[shared], minlength=m), g[shared], b"", ids.tobytes(), _planes(ns), docs=doc.tobytes(), nulls=np.packbits(null).tobytes(), of=_planes(of))]
        row, g = row[~shared], g[~shared]
        dest, to = (((x >> np.uint64(33)) % ranges).astype(np.int64) for x in (g, marks))
        order, mark_order = np.argsort(dest, kind="stable"), np.argsort(to, kind="stable")
        cut, mark_cut = (np.searchsorted(x, np.arange(len(keys) + 1)) for x in (dest[order], to[mark_order]))
        for i in np.flatnonzero((cut[1:] > cut[:-1]) | (mark_cut[1:] > mark_cut[:-1])).tolist():
            part = order[cut[i] : cut[i + 1]]
            rows.append(_row(keys[i], b, np.bincount(row[part], minlength=m), g[part], marks[mark_order[mark_cut[i] : mark_cut[i + 1]]].tobytes()))
        return _batch(rows)

    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        docs = postings = 0
        for batch in slices(batches):
            ids = batch.column(0)
            null, doc = ids.is_null().to_numpy(zero_copy_only=False).astype(bool), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, data, bounds in pieces(batch.column(1)):
                row, g, n, _, own = _sets(data, bounds, k)
                fresh = np.zeros(len(n), bool)
                for i, x in enumerate(own.tolist()):
                    if n[i] and x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                pick = fresh[row]
                held.append((row[pick] + docs, g[pick], own, n, doc[lo : lo + len(n)], null[lo : lo + len(n)]))
                docs += len(n)
                postings += int(pick.sum())
                if postings >= enough or docs >= MOST_DOCS:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, docs, postings = [], 0, 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, _DEALT)


def _shared(dealt: DataFrame) -> DataFrame:
    """Postings of shared shingles, on their way to the tasks of their batches."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("k")[0].as_py() < 0:
            return table
        bs = table.column("b").to_pylist()
        counts = [_numbers(x) for x in table.column("counts").to_pylist()]
        rows = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        marks = [np.frombuffer(x, np.uint64) for x in table.column("marks").to_pylist()]
        del table
        g = np.concatenate((rows, *marks))
        order = np.argsort(g)
        first = np.flatnonzero(np.concatenate(([True], g[order[1:]] != g[order[:-1]]))) if len(g) else np.empty(0, int)
        times = np.diff(np.concatenate((first, [len(g)])))
        often = np.empty(len(g), np.uint32)
        often[order] = np.repeat(times, times)
        del g, order, first, times
        keep = np.flatnonzero(often[: len(rows)] > 1)
        kept, kept_often = rows[keep], often[keep]
        # the row of a batch that each kept posting is of, from the counts of its batch
        size = np.array([c.sum() for c in counts], np.int64)
        cut = np.searchsorted(keep, np.concatenate(([0], np.cumsum(size))))
        out, at, mark_at = [], 0, len(rows)
        for i, (b, c, m) in enumerate(zip(bs, counts, marks)):
            part, mark_often = slice(cut[i], cut[i + 1]), often[mark_at : mark_at + len(m)]
            more = mark_often > 1
            if cut[i] < cut[i + 1] or more.any():
                own = np.repeat(np.arange(len(c)), c)[keep[part] - at]
                out.append(_row(0, b, np.bincount(own, minlength=len(c)), kept[part], m[more].tobytes(), often=_planes(kept_often[part]), marks_often=_planes(mark_often[more])))
            at += int(size[i])
            mark_at += len(m)
        return pa.Table.from_batches([_batch(out)])

    return dealt.groupBy("k").applyInArrow(run, _DEALT)


def _survivors(shared: DataFrame, percent: int) -> DataFrame:
    """All sets with their documents: id, n, docs; those with enough shared shingles also with hashes (rare ones first) and those of the prefix that are shared.

    A set that several batches dealt may be there more than once, a document
    is there once for each of its rows.
    """
    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "n": [], "docs": [], "hashes": [], "prefix": []}
        homes = [r for r in table.select(["ids", "ns", "docs", "nulls", "of"]).to_pylist() if r["ids"]]
        ids, ns = np.frombuffer(homes[0]["ids"], np.int64), _numbers(homes[0]["ns"])
        doc, of = (np.concatenate(x) for x in zip(*((np.frombuffer(h["docs"], np.int64), _numbers(h["of"])) for h in homes)))
        null = np.concatenate([np.unpackbits(np.frombuffer(h["nulls"], np.uint8))[: len(h["docs"]) // 8] for h in homes])
        own, gs, often, marks, marks_often = [], [], [], [], []
        for r in table.select(["counts", "hashes", "often", "marks", "marks_often"]).to_pylist():
            c = _numbers(r["counts"])
            own.append(np.repeat(np.arange(len(c)), c))
            gs.append(np.frombuffer(r["hashes"], np.uint64))
            often.append(_numbers(r["often"]) if r["often"] else np.ones(len(gs[-1]), np.int64))
            marks.append(np.frombuffer(r["marks"], np.uint64))
            marks_often.append(_numbers(r["marks_often"]))
        own, g, often = map(np.concatenate, (own, gs, often))
        marks, at = np.unique(np.concatenate(marks), return_index=True)
        if len(marks):  # shingles that were shared in this batch get their count from elsewhere
            place = np.minimum(np.searchsorted(marks, g), len(marks) - 1)
            often = np.where(marks[place] == g, np.concatenate(marks_often)[at][place], often)
        order = np.lexsort((g, often, own))
        own, g = own[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (own[1:] != own[:-1]) | (g[1:] != g[:-1])  # if a batch was dealt twice
        own, g = own[new], g[new]
        size = np.bincount(own, minlength=len(ids))
        first = np.concatenate(([0], np.cumsum(size)))
        enough = (size >= _needed(ns, percent)) & (size > 0)
        for i in range(len(ids)):
            a, m, n = int(first[i]), int(size[i]), int(ns[i])
            out["hashes"].append(g[a : a + m].tobytes() if enough[i] else None)
            out["prefix"].append(g[a : a + m - int(_needed(n, percent)) + 1].view(np.int64) if enough[i] else None)
        by_set = np.argsort(of, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ids))))).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[by_set], mask=null[by_set].astype(bool)))
        return pa.table([pa.array(ids), pa.array(ns), members, pa.array(out["hashes"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64()))], names=list(out))

    return shared.groupBy("b").applyInArrow(run, "id bigint, n bigint, docs array<bigint>, hashes binary, prefix array<bigint>")


def product(n: np.ndarray, rows: list[bytes], percent: int, left: np.ndarray | None = None) -> np.ndarray:
    """A label for each row such that rows joined by links have equal ones, if no pair is left out.

    With ``left`` (a mask), only pairs with one row of it are compared.
    """
    m = len(n)
    sets = [np.frombuffer(r, np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    own, g = np.repeat(np.arange(m), size), np.concatenate(sets)
    _, column, degree = np.unique(g, return_inverse=True, return_counts=True)
    own, column = own[degree[column] > 1], column[degree[column] > 1]
    label = np.arange(m)
    todo = np.arange(m) if left is None else np.flatnonzero(left)
    dense = degree > 48
    hot = np.flatnonzero(dense)
    place = np.zeros(len(degree), np.int64)
    place[hot] = np.arange(len(hot))
    by_col = np.argsort(column, kind="stable")
    col_own, col_first = own[by_col], np.concatenate(([0], np.cumsum(np.bincount(column, minlength=len(degree)))))
    by_row = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=m))))
    is_hot = dense[column]
    for lo in range(0, len(todo), 128):
        part = todo[lo : lo + 128]
        at = np.concatenate([np.arange(by_row[r], by_row[r + 1]) for r in part]) if len(part) else np.empty(0, int)
        local = np.repeat(np.arange(len(part)), by_row[part + 1] - by_row[part])
        rare = ~is_hot[at]
        cols, who = column[at[rare]], local[rare]
        times = col_first[cols + 1] - col_first[cols]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = col_own[np.repeat(col_first[cols], times) + step]
        overlap = np.bincount(np.repeat(who, times) * m + other, minlength=len(part) * m).reshape(len(part), m).astype(np.float32)
        for c in range(0, len(hot), 2048):  # frequent columns, in strips
            width = min(2048, len(hot) - c)
            inside = is_hot & (place[column] >= c) & (place[column] < c + width)
            strip = np.zeros((m, width), np.float32)
            strip[own[inside], place[column[inside]] - c] = 1
            overlap += strip[part] @ strip.T
        overlap = overlap.astype(np.int64)
        a, b = np.nonzero(100 * overlap >= percent * (n[part][:, None] + n[None, :] - overlap))
        a = part[a]
        while True:  # smallest label along links
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, before, label)
            label = label[label]
            if (label == before).all():
                break
    return label


def _edges(grouped, percent: int) -> DataFrame:
    """Links (u, v) that span what each group's product joins.  Columns: id, n, hashes, left."""
    def run(table: pa.Table) -> pa.Table:
        _, one = np.unique(table.column("id").to_numpy(), return_index=True)
        table = table.take(pa.array(one))
        n, ids = table.column("n").to_numpy(), table.column("id").to_numpy()
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        label = product(n, table.column("hashes").to_pylist(), percent, None if left.all() else left)
        moved = label != np.arange(len(n))
        return pa.table([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    return grouped.applyInArrow(run, "u bigint, v bigint")


def _large(rows: DataFrame, sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """Links within components of more than ``block`` rows.  rows: root, id, n, hashes.

    First every part of a component is multiplied with itself and with the
    component's hubs.  Rows that are connected so need no more comparisons
    with each other: only rows outside the largest connected core are then
    multiplied with all rows, part by part.
    """
    base = rows.join(sizes.select("root", F.ceil(F.col("size") / (block - HUBS)).alias("parts")), "root")
    base = base.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    order = F.xxhash64("id", F.lit(1))
    near = base.where(F.pmod(order, F.greatest(F.lit(1), F.floor(F.col("parts") * block / (HUBS * 4)))) == 0)
    hubs = near.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(order, "id"))).where(F.col("r") <= HUBS)
    away = hubs.withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part != own")
    cols = ["root", "part", "id", "n", "hashes", F.lit(True).alias("left")]
    first = stored(_edges(base.select(*cols).union(away.select(*cols)).groupBy("root", "part"), percent), "links")
    joined = components(first)
    core = base.join(joined.select("id", F.col("root").alias("core")), "id", "left").withColumn("core", F.coalesce("core", "id"))
    core = stored(core, "cores")
    best = core.groupBy("root", "core").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max_by("core", F.struct("c", "core")).alias("best"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most")
    core = core.join(best.select("root", "best", (F.col("all") - F.col("most")).alias("rest")), "root")
    half = F.lit(block // 2)
    lost = core.where("core != best").withColumn("lpart", F.pmod(F.xxhash64("id"), F.ceil(F.col("rest") / half)))
    parts2 = 2 * F.col("parts")
    mpart = F.pmod(F.xxhash64("id"), parts2)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    a = lost.withColumn("mpart", spread(parts2)).select("root", "lpart", "mpart", "id", "n", "hashes", F.lit(True).alias("left"))
    b = core.withColumn("mpart", mpart).withColumn("lpart", spread(F.ceil(F.col("rest") / half))).select("root", "lpart", "mpart", "id", "n", "hashes", F.lit(False).alias("left"))
    both = a.union(b).groupBy("root", "lpart", "mpart", "id").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.max("left").alias("left"))
    return first.union(_edges(both.groupBy("root", "lpart", "mpart"), percent))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their
    sets of k-word shingles (A-Z lower-cased, words split at ASCII white
    space); fewer than k words are one shingle, and a similarity of exactly
    the bound is a link.  component_id is the smallest doc_id that is reachable
    by links.  Null, empty and blank texts have an empty set and link with
    nothing.  Repeated rows are exact copies and stay as rows; a null doc_id
    stays null and gets its component's smallest doc_id, if any.  Ids are whole
    numbers; other types are an error.  An empty table gives an empty one, and
    other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    whole_ids(docs, doc_id)
    keys = _even_keys(spark, partitions(spark), 2)
    # the one pass over the texts; its table has all that follows
    table = stored(_survivors(_shared(_deal(docs, doc_id, text, k, keys)), percent), "rows")
    meta = table.select("id", "n", F.explode("docs").alias("doc_id"))
    rows = table.where("hashes is not null").select("id", "n", "hashes", "prefix")
    prefix = rows.select("id", F.explode("prefix").alias("hash"))
    low = prefix.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("hash", "low")
    blocks = components(prefix.join(low, "hash").where("id != low").select(F.col("id").alias("u"), F.col("low").alias("v")))
    blocks = blocks.union(blocks.select(F.col("root").alias("id"), "root").distinct())
    sizes = blocks.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = blocks.join(sizes, "root").join(rows.select("id", "n", "hashes"), "id")
    small = members.where(F.col("size") <= block).withColumn("left", F.lit(True))
    links = _edges(small.select("root", "id", "n", "hashes", "left").groupBy("root"), percent)
    large = sizes.where(F.col("size") > block)
    if not large.isEmpty():
        links = links.union(_large(members.where(F.col("size") > block).select("root", "id", "n", "hashes"), large, percent, block))
    linked = components(links)
    linked = linked.union(linked.select(F.col("root").alias("id"), "root").distinct())
    classes = meta.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"))
    least = linked.join(classes, "id").groupBy("root").agg(F.min("rep").alias("least"))
    named = classes.join(linked.join(least, "root").select("id", "least"), "id", "left").select("id", F.coalesce("least", "rep").alias("component_id"))
    # both sides of the last join are tables, so that the rows of a set with very many copies are split
    named = stored(named, "named")
    return meta.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
