"""Words of UTF-8 texts as numpy arrays, whole batches at a time.

A batch of texts is one byte buffer.  Word classes here differ only in ASCII,
so a table of 256 entries tells word bytes from others, and a polynomial
prefix hash modulo 2**64 gives every word or n-gram a 64-bit hash without a
Python object per word.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder  # noqa: F401

#: Texts handled at once, in bytes; a longer text is handled alone, whole.
PIECE = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_P = 0x9E3779B97F4A7C15 | 1


class _Own(dict):
    """What a process makes for itself: functions that are sent to executors take none of it along."""

    def __reduce__(self):
        return _Own, ()


_CACHE = _Own()


def _tables() -> dict:
    """Word classes, byte values and powers; made once a process."""
    if not _CACHE:
        byte = np.arange(256)
        solid = np.ones(256, bool)
        solid[[0x20, *range(0x09, 0x0E)]] = False
        upper = (byte >= 65) & (byte <= 90)
        alnum = (byte >= 0x80) | ((byte >= 48) & (byte <= 57)) | ((byte >= 97) & (byte <= 122)) | upper
        value = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        value[upper] = value[np.flatnonzero(upper) + 32]
        _CACHE.update(solid=solid, alnum=alnum, value=value, pow=np.ones(1, np.uint64), inv=np.ones(1, np.uint64))
    return _CACHE


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**j and p**-j modulo 2**64 for j up to n."""
    t = _tables()
    if len(t["pow"]) <= n:
        m = max(n + 1, PIECE + 1024)
        for name, base in (("pow", _P), ("inv", pow(_P, -1, 1 << 64))):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            t[name] = np.cumprod(a)
    return t["pow"], t["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def slices(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows, so that what is made of one is small; Spark bounds a batch by its bytes only."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def pieces(column, limit: int = PIECE):
    """Slices (first row, byte buffer, bounds) of a string column; null is the empty text."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        if not len(chunk):
            continue
        at = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None and chunk.buffers()[2].size else np.empty(0, np.uint8)
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def words(data: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes), rows and hashes of all words; A-Z count as a-z.

    kind: "solid" takes ``[^\\x20\\x09-\\x0D]+``, "alnum" takes
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text.
    """
    t, n = _tables(), len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    inside = t[kind][data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    first[bounds[full]] = inside[bounds[full]]
    last[bounds[full + 1] - 1] = inside[bounds[full + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(t["value"][data] * up[:n], out=total[1:])
    return start, end, row, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


_ODD = [np.uint64(pow(_P, k + 3, 1 << 64)) for k in range(64)]


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences that stay within a row, and the word each begins at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g += h[j : j + n] * _ODD[j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(g[at]), at


def lower_ascii(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def sql_lower(column):
    """A-Z to a-z and nothing else; the cheap built-in where a text is ASCII."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def whole_ids(df: DataFrame, *names: str) -> None:
    """Refuse id columns that are not whole numbers, before anything runs."""
    for c in names:
        kind = df.schema[c].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{c} has to be a whole number (bigint), not {kind}")


#: Paths of the tables that this process has stored and not released.
_MADE: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Stored tables of this process that are still there, oldest first."""
    return list(_MADE)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
