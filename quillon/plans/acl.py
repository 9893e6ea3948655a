"""Attribute-based access: which rows a principal may see.

A policy is a list of grants ``{"principal", "signals", "where"}``.  where is
a list of conditions ``{"attr", "op", "value"}`` that must all hold, with op
"==" or "in"; the attribute "tenant" is the tenant, "service" the service and
any other a resource attribute.  ``"all"`` in place of the list sees all
rows.  Without a grant nothing is seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import attribute

HEADS = {"tenant": "tenant_id", "service": "service"}


def condition(c: dict) -> Column:
    attr, op, value = c["attr"], c["op"], c["value"]
    col = F.col(HEADS[attr]) if attr in HEADS else attribute("resource.attributes", attr)
    if op == "==":
        return col == value
    if op == "in":
        return col.isin(list(value))
    raise ValueError(f"unknown operator {op!r}")


def grant(g: dict) -> Column:
    if g["where"] == "all":
        return F.lit(True)
    return reduce(lambda a, b: a & b, map(condition, g["where"]), F.lit(True))


def allowed(policy: list[dict], principal: str, signal: str) -> Column:
    """Any of the principal's grants on the signal; null counts as no."""
    mine = [grant(g) for g in policy if g["principal"] == principal and signal in g["signals"]]
    return F.coalesce(reduce(lambda a, b: a | b, mine, F.lit(False)), F.lit(False))


def restrict(df: DataFrame, policy: list[dict], principal: str, signal: str) -> DataFrame:
    """To be applied before any filter of the user."""
    return df.where(allowed(policy, principal, signal))
