"""Best-fit packing of token runs into sequences of several permitted lengths.

Texts are cut into pieces no longer than the largest capacity, and the pieces
(ids and lengths only) are dealt into shards of bounded size by a hash.  In a
shard the pieces go, longest first, to the open bin with the least room that
fits; where none fits, a bin is opened at the size that costs least.  All
opening policies that the permitted lengths allow are tried together, each is
finished by downsizing every bin to the smallest length that holds it, and
the cheapest result stays.  The loss against one global packing is at most
one partly filled bin per length and shard.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import stored, whole_ids

CAPACITIES = (256, 512, 1024, 2048)
#: What a sequence costs beside its length, in tokens.
OVERHEAD = 16
#: Pieces of one shard, about.
SHARD = 20_000
WORD = r"[^\x20\x09-\x0D]+"
PACKED = "doc_id bigint, piece bigint, start bigint, length bigint, shard bigint, bin bigint, capacity bigint, used bigint, position bigint"


def _fill(lengths: list[int], sizes: list[int], opens: list[int]) -> tuple[list[int], list[int]]:
    """Bins of pieces given longest first; opens: the size of a bin opened for a piece of a length.

    Returns the bin of each piece and the room left in each bin as opened.
    """
    where, room, size = [], [], []
    by_room: dict[int, list[int]] = {}
    filled = 0  # bit r is set while some bin has room r
    for n in lengths:
        fits = filled >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            bins = by_room[r]
            b = heapq.heappop(bins)  # of equal room, the bin opened first
            if not bins:
                filled &= ~(1 << r)
        else:
            b, r = len(room), opens[n]
            room.append(r)
            size.append(r)
        room[b] = r - n
        where.append(b)
        if r > n:
            heapq.heappush(by_room.setdefault(r - n, []), b)
            filled |= 1 << (r - n)
    return where, [s - r for s, r in zip(size, room)]


def pack(lengths: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin of each length (in the given order), and capacity and contents of each bin.

    The policies: bins open at the k-th permitted length, or at the smallest
    one above it that holds the piece, for each k; and at the length with the
    least cost for each token of the piece.  Ties keep the first policy.
    """
    sizes = sorted(set(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    least = [next((s for s in sizes if s >= n), sizes[-1]) for n in range(sizes[-1] + 1)]
    fair = [min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / (s // max(1, n) * max(1, n)), -s)) for n in range(sizes[-1] + 1)]
    best = None
    for opens in [[max(s, x) for x in least] for s in sizes] + [fair]:
        where, used = _fill([lengths[i] for i in order], sizes, opens)
        final = [least[u] for u in used]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, where, final, used
    _, where, final, used = best
    bins = [0] * len(lengths)
    for i, b in zip(order, where):
        bins[i] = b
    return bins, final, used


def best_fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities=CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, length=None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, shard, bin, capacity, used, position.

    ``length`` is a column of token counts; where it is None, words of the
    text count.  A document longer than the largest capacity is cut into
    pieces of that length and a rest, so that all its tokens are packed.
    bin is unique in its shard, capacity the permitted length it ends with,
    used the tokens in it, position the offset of the piece in it.  Null and
    empty texts have no tokens and no rows.  Repeated rows are packed as often
    as they stand there; a null doc_id stays null.  Pieces of one length are
    taken in the order of doc_id (null last), piece and a hash of the text, so
    the result does not depend on partitions.  A very long text is counted
    whole and only its length travels.  An empty table gives an empty one.  Ids
    are whole numbers, other types are an error; other columns are left out.
    """
    whole_ids(docs, doc_id)
    spark, top = docs.sparkSession, max(capacities)
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) if length is None else F.coalesce(length, F.lit(0))
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), n.cast("long").alias("n"), F.xxhash64(F.col(doc_id), F.col(text) if text in docs.columns else F.lit(0)).alias("h")).where("n > 0")
    sized = stored(sized, "sizes")  # counted once, for the number of shards and for the pieces
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top)))
    pieces = sized.select("doc_id", "h", "n", cut.alias("piece")).select("doc_id", "h", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("length"))
    total = sized.agg(F.sum(F.floor((F.col("n") - 1) / top) + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("h", "piece"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        # rows that are alike in all of these are alike
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("h", "ascending")])
        sizes = table.column("length").to_pylist()
        bins, final, used = pack(sizes, capacities, overhead)
        at, position = [0] * len(final), []
        for b, x in zip(bins, sizes):
            position.append(at[b])
            at[b] += x
        col = lambda x: pa.array(x, pa.int64())
        names = ["doc_id", "piece", "start", "length", "shard"]
        return pa.table({c: table.column(c).cast(pa.int64()) for c in names} | {"bin": col(bins), "capacity": col([final[b] for b in bins]), "used": col([used[b] for b in bins]), "position": col(position)})

    return dealt.groupBy("shard").applyInArrow(run, PACKED)
