"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, license_scan, line_dedup, near_dup, packing, quality, secret_scan, toxicity, url_filter
from .text import LOWER, UPPER


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda p: p["start"])
    names = lambda c: F.transform(c, lambda p: p["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(names("base")).alias("base_labels"), joined(F.concat(names("base"), names("covered"))).alias("labels"), "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, _read(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return out.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_text=False).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "quality", "quality_text", "quality_meta", "kept")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.pairs(_read(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def queries() -> dict:
    ops = (op1_toxicity, op2_url_filter, op3_line_dedup, op4_license_scan, op5_decontaminate, op6_quality, op7_near_dup, op8_packing, op9_jaccard, op10_secret_scan)
    return {f.__name__: f for f in ops}


#: A-Z to a-z and nothing else.
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A document is a row.
_OP3 = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), E'\\n') AS part FROM documents),
lines AS (SELECT r, doc_id, i, part[i] AS line, translate(trim(part[i], E' \\t\\n\\x0b\\x0c\\r'), '{UPPER}', '{LOWER}') AS key FROM docs, generate_series(1, len(part)) AS g(i)),
often AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(l.line, E'\\n' ORDER BY l.i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON o.key = l.key GROUP BY l.r"""

_OP5 = rf"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, w, least(8, len(w)) AS k FROM items WHERE len(w) > 0), generate_series(1, len(w) - k + 1) AS g(i)),
sizes AS (SELECT DISTINCT k FROM win),
found AS (SELECT d.doc_id, d.i, d.k, win.item
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM docs, sizes, generate_series(1, len(w) - k + 1) AS g(i)) d
  JOIN win ON win.k = d.k AND win.s = d.s),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, generate_series(0, k - 1) AS g(j) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)"""

_OP9 = r"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(""" + _LOW + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM docs, generate_series(1, greatest(1, len(w) - 4)) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)"""


_OP7 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) >= 0.98 * (a.n * b.n)),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least l ON l.x = v.vec_id LEFT JOIN degree d ON d.x = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.sql(), "op3_line_dedup": _OP3, "op5_decontaminate": _OP5, "op7_near_dup": _OP7, "op9_jaccard": _OP9}
