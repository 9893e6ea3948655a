"""A corpus through five stages: quality, lines, near copies, benchmark passages, packing.

Every stage takes whole texts, null, empty or very long ones, and an empty
table; ids are whole numbers or null.  All but the last return exactly the
columns of documents, whatever else was there, and rows that they do not
touch as they are: repeated rows are decided alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, line_dedup, packing, quality
from quillon.llm.text import made, release, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of documents that go are broadcast up to this number (16 MB); beyond it they are joined by shuffle.
MOST_IDS = 1_000_000
#: None: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: a probability of 0.5 or more, null and empty texts like others.

    Equal rows are kept or go together.  Without usable labels all that have
    the larger share stay.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share; repeated rows count as often as they stand there.

    A document of such lines only stays, with an empty text; a null text
    becomes an empty one.
    """
    return _documents(line_dedup.dedup(docs).withColumn("text", F.col("kept_text")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Documents without words link with nothing, and those without an id are
    never the ones that go: they stay.  Where ids are repeated, rows of one id
    and text are one, and rows of one id with other texts are documents of
    their own: each group keeps one row, whatever becomes of its id elsewhere.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_copies_by_row(docs)
    gone = stored(jaccard.join(docs.select("doc_id", "text")).where("component_id != doc_id").select("doc_id").distinct(), "gone")
    small = gone.count() <= MOST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*COLUMNS)


def _near_copies_by_row(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest id, then the smallest hash of id and text, then the smallest values."""
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    linked = jaccard.join(rows.select("row", "text"), "row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    best = linked.join(rows.where("doc_id is not null").select("row", "doc_id").distinct(), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    best = stored(best.select("best.row"), "best")
    one = rows.where("doc_id is not null").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("one"))
    return one.join(best, "row", "left_semi").select("one.*").union(docs.where("doc_id is null").select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of fewer than two benchmark items, without the words of those.

    Null texts become empty ones; an empty benchmark changes nothing else.
    """
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    return _documents(found.where(F.size("items") < 2).withColumn("text", F.coalesce("clean_text", F.lit(""))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of the permitted lengths; those without words have none, repeated rows their own."""
    return packing.best_fit(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_copies", near_copy_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are a Parquet table that the next one reads."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before = made()
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage stored on its way, and the table that it read, are not read again
        *own, table = [p for p in made() if p not in before]
        release(spark, own + last)
        last = [table]
    return STAGES[-1][1](spark, docs, sf_dir)
