"""Line deduplication across documents, with built-in functions only.

Lines are exploded with their positions; the key of a line is the line with
ASCII white space stripped at both ends and A-Z lower-cased, and is counted
by a 128-bit hash.  Keys are distinct within a document before they are
counted, so counting is one aggregation with map-side sums and a line that
stands in a third of all documents is a few partial sums.  Only hashes travel
twice; each text that loses lines meets the positions it loses once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sql_lower, stored

BLANK = " \t\n\x0b\x0c\r"
#: A line goes when its key stands in this many documents and has this many code points.
MIN_DOCS, MIN_KEY = 10, 1
MADE = ("n_lines", "n_dropped", "kept_text")


def _id(*cols: Column) -> list[Column]:
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]


def line_key(line: Column) -> Column:
    return sql_lower(F.btrim(line, F.lit(BLANK)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(lines: Column, gone: Column) -> Column:
    """The lines at other positions than those that go, joined; one hashed pass over the positions."""
    def join(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(stay, lambda i: F.get(x["lines"], i)), "\n")

    # a lambda's variable, so that the text is split once and not at every position
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), join), F.lit(0))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_key: int = MIN_KEY) -> DataFrame:
    """All columns of ``docs`` and rows, with n_lines, n_dropped and kept_text.

    A document is a row, whatever its id: repeated rows count as often as they
    stand there, and rows of one id (null, too) with other texts are documents
    of their own.  A null text is an empty one, which is one empty line.  Keys
    shorter than ``min_key`` are never dropped; a key that stands in exactly
    ``min_docs`` documents goes.  A document that loses all its lines has an
    empty kept_text.  An empty table gives an empty one.  Work on a text is in
    proportion to its length, whatever its lines.  Columns with the names of
    results are replaced; all others stay as they are.
    """
    stay = [c for c in docs.columns if c not in MADE]
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(stay) if c != text))
    base = docs.select(rest.alias("row"), F.col(text).alias("text"), *_id(F.col(doc_id), F.col(text)))
    rows = base.select("h1", "h2", "text")
    rows = rows.select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), lines_of(F.col("text")).alias("lines"))
    # distinct keys of a row, so that counting the rows of a key counts documents
    keys = F.array_distinct(F.transform("lines", line_key))
    counted = rows.select(F.explode(keys).alias("key")).where(F.char_length("key") >= min_key).select(*_id(F.col("key")))
    counted = counted.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h1", "h2")
    # as a table of known size: a small one is broadcast, and a large one leaves the join free to split a very common line
    counted = stored(counted, "lines")
    placed = rows.select("d1", "d2", F.posexplode("lines").alias("pos", "line"))
    placed = placed.select("d1", "d2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_key).select("d1", "d2", "pos", *_id(F.col("key")))
    gone = placed.join(counted, ["h1", "h2"], "left_semi").groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))
    out = base.withColumnsRenamed({"h1": "d1", "h2": "d2"}).join(gone, ["d1", "d2"], "left")
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_without(lines_of(F.col("text")), F.col("gone")))
    made = (F.coalesce(n, F.lit(1)).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long"), kept)
    return out.select(*((F.col("text") if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(stay)), *(c.alias(name) for c, name in zip(made, MADE)))
