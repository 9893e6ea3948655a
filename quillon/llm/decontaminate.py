"""Benchmark decontamination by word windows.

The windows of the benchmark items form a sorted array of 64-bit hashes with
a bitmap before it and, for each hash, the places of its windows in the words
of the items; it is packed in numpy arrays (about 30 bytes a word) and
broadcast in blocks of bounded size.  Texts are scanned window by window in
one pass over all blocks, and every hash that is found is verified against
the words themselves, so a collision is never a hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import grams, slices, pieces, words

WINDOW = 8
#: Items of one broadcast block, and its bytes of text; of a larger benchmark a process holds one block at a time.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_BITS, BATCH_ROWS = 20, 1000
HITS = T.StructType().add("n_words", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("items", T.ArrayType(T.StringType())).add("clean_text", "string")


def _windows(items: list[tuple[str, str]], window: int) -> dict:
    """The packed table of a block of (item id, text)."""
    low, first, last, found = [], [], [], {}
    n = size = 0
    for lo, data, bounds in pieces(pa.array([t for _, t in items], pa.large_string())):
        start, end, row, h = words(data, bounds, "alnum")
        count = np.bincount(row, minlength=len(bounds) - 1) if len(row) else np.zeros(len(bounds) - 1, np.int64)
        for k in np.unique(np.minimum(count[count > 0], window)).tolist():
            pick = np.flatnonzero((np.minimum(count, window) == k)[row])
            g, at = grams(h[pick], row[pick], k)
            found.setdefault(k, []).append((g, (pick[at] + n).astype(np.int32), (row[pick[at]] + lo).astype(np.int32)))
        low.append(data.tobytes().lower())
        first.append((start + size).astype(np.int32))
        last.append((end + size).astype(np.int32))
        n, size = n + len(h), size + len(data)
    by = {}
    for k, parts in found.items():
        g, at, item = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(g, kind="stable")
        keys, begin = np.unique(g[order], return_index=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        by[k] = keys, bits, np.append(begin, len(g)).astype(np.int32), at[order], item[order]
    none = [np.empty(0, np.int32)]
    return {"by": by, "items": [i for i, _ in items], "low": b"".join(low), "start": np.concatenate(first or none), "end": np.concatenate(last or none)}


def _owners(known: dict, k: int, key: int, text: bytes) -> frozenset[str]:
    """Items with exactly this window, among those of its hash."""
    _, _, first, at, item = known["by"][k]
    low, start, end, own = known["low"], known["start"], known["end"], set()
    for i in range(first[key], first[key + 1]):
        if b" ".join(low[start[j] : end[j]] for j in range(at[i], at[i] + k)) == text:
            own.add(known["items"][item[i]])
    return frozenset(own)


class _Piece:
    """The words of some texts, and what the blocks so far have hit in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        self.start, self.end, self.row, self.h = words(data, bounds, "alnum")
        self.edge, self.items, self.hit = np.zeros(len(self.h) + 1, np.int64), {}, None
        self.first = np.searchsorted(self.row, np.arange(len(bounds)))

    def look(self, known: dict) -> None:
        """Add the hits of a block."""
        low, owners = None, {}
        for k, (keys, bits, *_) in known["by"].items():
            g, at = grams(self.h, self.row, k)
            maybe = np.flatnonzero(bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            place = np.searchsorted(keys, g[maybe])
            place[place == len(keys)] = 0
            same = keys[place] == g[maybe]
            for key, i in zip(place[same].tolist(), at[maybe[same]].tolist()):
                low = self.data.tobytes().lower() if low is None else low
                text = b" ".join(low[self.start[j] : self.end[j]] for j in range(i, i + k))
                who = owners.get((k, text))
                if who is None:
                    who = owners[k, text] = _owners(known, k, key, text)
                if who:
                    self.edge[i] += 1
                    self.edge[i + k] -= 1
                    self.items.setdefault(int(self.row[i]), set()).update(who)

    def spans(self, i: int) -> list[tuple[int, int]]:
        """Runs of hit words of a text, in its words."""
        if i not in self.items:
            return []
        if self.hit is None:  # once all blocks have been looked at
            self.hit = (np.cumsum(self.edge)[:-1] > 0).astype(np.int8)
        edge = np.diff(np.concatenate(([0], self.hit[self.first[i] : self.first[i + 1]], [0])))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))

    def without(self, i: int) -> bytes:
        """A text without its hit words."""
        text, lo, a = self.data[self.bounds[i] : self.bounds[i + 1]].tobytes(), int(self.bounds[i]), int(self.first[i])
        out, at = [], 0
        for s, e in self.spans(i):
            out.append(text[at : self.start[a + s] - lo])
            at = int(self.end[a + e - 1]) - lo
        return b"".join([*out, text[at:]])


def _tables(blocks: list):
    """The blocks one after the other; with several, each leaves the process's memory before the next (its file stays)."""
    for shared in blocks:
        yield shared.value
        if len(blocks) > 1:
            vars(shared).pop("_value", None)


def _looked(column, blocks: list) -> list[tuple[int, _Piece]]:
    """Pieces of a string column, with their first rows, after a look at all blocks."""
    parts = [(lo, _Piece(data, bounds)) for lo, data, bounds in pieces(column)]
    for known in _tables(blocks):
        for _, part in parts:
            part.look(known)
    return parts


def _cleaned(texts: dict[int, bytes], blocks: list) -> dict[int, bytes]:
    """Texts without hit words, again and again until no window of any block is left in them."""
    out, todo = {}, texts
    while todo:
        rows, bodies = list(todo), pa.array([x.decode("utf-8", "surrogatepass") for x in todo.values()], pa.large_string())
        out |= todo
        todo = {rows[lo + i]: part.without(i) for lo, part in _looked(bodies, blocks) for i in part.items}
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """Lists of (item id, text), of bounded size each, in the order of the ids."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    block, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator(prefetchPartitions=False):
        block.append((r.i, r.t))
        size += len(r.t.encode("utf-8", "surrogatepass"))
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, clean: bool = False) -> DataFrame:
    """Columns of ``docs`` (without the text if ``clean``) with n_words, spans, items, clean_text.

    spans are runs of hit words [start, end), counted in words; items the ids
    (as strings, sorted) of benchmark items of which a window occurs.  With
    ``clean``, clean_text is the text without its hit words, scanned again
    until nothing is left to remove.  Null and empty texts have no words and
    no hits; items without an id or without words have no windows; an item of
    fewer words than the window is one window.  Repeated rows stay, repeated
    items count once, and rows of one item id with other texts are one item
    with the windows of all.  An empty benchmark hits nothing, an empty table
    gives an empty one.  Texts are scanned whole, about a megabyte of them at a
    time; a longer one alone.  Columns of ``docs`` with the names of results
    are replaced.

    The benchmark is broadcast in blocks of bounded size, which one pass over
    the documents takes one after the other, so the result is that of one
    block and a process holds the table of one at a time.
    """
    base, send = docs.drop(*HITS.names), docs.sparkSession.sparkContext.broadcast
    blocks = [send(_windows(b, window)) for b in _blocks(benchmark, item_id, item_text)]
    keep = [c for c in base.columns if c != text or not clean]

    def run(batches):
        for batch in slices(batches, BATCH_ROWS if len(blocks) < 2 else 1 << 30):  # several blocks are loaded anew for each
            n = batch.num_rows
            n_words, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            column = batch.column(batch.schema.get_field_index(text))
            clean_text, hit = column.to_pylist() if clean else [None] * n, {}
            for lo, part in _looked(column, blocks):
                n_words[lo : lo + len(part.bounds) - 1] = np.diff(part.first)
                for i, who in part.items.items():
                    spans[lo + i] = [{"start": a, "end": b} for a, b in part.spans(i)]
                    items[lo + i] = sorted(who)
                    if clean:
                        hit[lo + i] = part.without(i)
            for i, x in _cleaned(hit, blocks).items():
                clean_text[i] = x.decode("utf-8", "surrogatepass")
            made = [pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string())), pa.array(clean_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *made], names=[*keep, *HITS.names])

    return base.mapInArrow(run, T.StructType([*(base.schema[c] for c in keep), *HITS.fields]))


def n_hit():
    """Hit words, from the column spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
