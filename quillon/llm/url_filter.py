"""URL filters: site rules, then a weighted URL vocabulary.

Host and path are cut out with built-in functions and the site rules are one
CASE expression, so all of that stays in generated code.  For the urls that
no rule decides, an Aho-Corasick automaton counts strict and soft terms of
the lower-cased url (A-Z only) that have no ASCII letter or digit next to
them.  A url is rejected when the weights of its distinct terms reach 1:
one strict term, or several distinct soft ones.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LOWER, UPPER, lower_ascii

#: Terms by weight, 1 (strict) or below (soft): each line a weight and its terms.
TERMS = os.path.join(os.path.dirname(__file__), "url_terms.txt")
LIMIT = 1.0
#: (verdict, host, path).  Fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def load(path: str = TERMS) -> dict[str, float]:
    """A vocabulary from a file that the driver reaches; A-Z count as a-z, of a term's weights the largest counts."""
    out: dict[str, float] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            weight, *terms = line.split() or ["0"]
            for t in terms:
                t = lower_ascii(t).decode()
                out[t] = max(out.get(t, 0.0), float(weight))
    return out


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last tested is the longest, and of equal ones the first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _counter(vocabulary: dict[str, float]):
    """A function from a url to (strict hits, distinct soft hits, weight of distinct terms)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, term in enumerate(vocabulary):
        machine.add_word(term, (len(term), k))
    machine.make_automaton()
    weight = list(vocabulary.values())
    near = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def count(url: str | None) -> tuple[int, int, float]:
        if not url:
            return 0, 0, 0.0
        low = lower_ascii(url).decode("utf-8", "replace")
        hard, found = 0, set()
        for end, (n, k) in machine.iter(low):
            if low[end + 1 : end + 2] not in near and (end < n or low[end - n] not in near):
                found.add(k)
                hard += weight[k] >= 1
        return hard, sum(weight[k] < 1 for k in found), float(sum(weight[k] for k in found))

    return count


def judge(pages: DataFrame, url: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None, limit: float = LIMIT) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, strict_hits, soft_hits, weight, verdict.

    A null url or one without ``://`` has an empty host and path, fits no rule
    and is judged by its terms alone (null: none, allowed).  Of equally long
    rules that fit the first listed counts; a weight of exactly ``limit``
    blocks.  Urls of any length are judged whole.  Columns of ``pages`` with
    the names of results are replaced, all others stay.  Rows stay as they
    are, repeated ones too; an empty table gives an empty result.
    """
    vocabulary = load() if vocabulary is None else vocabulary
    made = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")
    stay = [c for c in pages.columns if c not in made]
    body = F.col(url)
    host, path = host_of(body), path_of(body)
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(stay)))
    base = pages.select(rest.alias("row"), body.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})

    def scan(batches):
        count = _counter(vocabulary)
        for b in batches:
            hits = [count(u) for u in b.column(1).to_pylist()]
            cols = [pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "strict_hits", "soft_hits", "weight"])

    fields = T.StructType([*base.schema.fields, T.StructField("strict_hits", T.LongType()), T.StructField("soft_hits", T.LongType()), T.StructField("weight", T.DoubleType())])
    out = base.mapInArrow(scan, fields)
    verdict = F.coalesce("ruled", F.when(F.col("weight") >= limit, "block").otherwise("allow")).alias("verdict")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(stay)), "host", "path", "rule", "strict_hits", "soft_hits", "weight", verdict)


def sql(rules=RULES, vocabulary: dict[str, float] | None = None, limit: float = LIMIT) -> str:
    """The same verdicts in DuckDB SQL."""
    vocabulary = load() if vocabulary is None else vocabulary
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    weight = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in vocabulary.items())
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(k, h, p)}'" for k, h, p in order)
    return f"""WITH cut AS (SELECT page_id, {low} AS low,
  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(lambda k, h, p: h + p)} END AS rule,
  {case(lambda k, h, p: k)} ELSE CASE WHEN {weight} >= {limit} THEN 'block' ELSE 'allow' END END AS verdict
FROM cut"""
