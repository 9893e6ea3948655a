"""Upserts, tombstones, deletes and retention as plans over stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import key_columns
from ..plans.predicates import sure


def latest(df: DataFrame, signal: str) -> DataFrame:
    """The last written row of each key.

    An aggregation with a map-side maximum, so a key that is written very
    often is one partial result per task; the row travels with it.
    """
    keys = key_columns(signal)
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct("ingest_seq", "ingest_row"))
    return df.groupBy(*keys).agg(top.alias("row")).select(*keys, "row.*").select(*df.columns)


def latest_by_window(df: DataFrame, signal: str) -> DataFrame:
    """The same rows by a ranking window; for rows too wide to aggregate."""
    w = Window.partitionBy(*key_columns(signal)).orderBy(F.desc("ingest_seq"), F.desc("ingest_row"))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def without_tombstones(df: DataFrame, tombstones: DataFrame, signal: str) -> DataFrame:
    """Rows whose key no tombstone names."""
    return df.join(tombstones.select(*key_columns(signal)).distinct(), key_columns(signal), "left_anti")


def without(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that the predicate is not true of; where it is null they stay."""
    return df.where(~sure(predicate))


def retained(df: DataFrame, cutoff: str) -> DataFrame:
    """Rows that came in on the cutoff date or later; whole partitions are left out."""
    return df.where(F.col("ingest_date") >= F.lit(cutoff).cast("date"))


def as_of(df: DataFrame, seq: int) -> DataFrame:
    """Rows as they were after a given write."""
    return df.where(F.col("ingest_seq") <= seq)
