"""Whose row it is: tenants from resource attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import attribute

DEFAULT = "default"
#: Keys tried where a resolver has none, in this order, and those of the default configuration.  Fixed values.
WELL_KNOWN = ("tenant.id", "tenant_id", "k8s.namespace.name", "service.namespace")
CONFIGURED = ("tenant.id", "tenant_id", "k8s.namespace.name")


@dataclass(frozen=True)
class Resolver:
    """strategy "attribute_based" tries attributes in order; any other gives the default tenant."""

    strategy: str = ""
    attributes: tuple[str, ...] = ()
    default: str = ""

    def column(self, attributes: Column | str = "resource.attributes") -> Column:
        """The tenant: for the first key with a non-empty string value, the first such value; else the default."""
        last = F.lit(self.default or DEFAULT)
        if self.strategy != "attribute_based":
            return last
        return F.coalesce(*(attribute(attributes, k, filled=True) for k in self.attributes or WELL_KNOWN), last)

    def resolve(self, df: DataFrame, attributes: str = "resource.attributes") -> DataFrame:
        """``df`` with tenant_id."""
        return df.withColumn("tenant_id", self.column(attributes))

    def batch(self, df: DataFrame, attributes: str = "resource.attributes") -> DataFrame:
        """Rows with tenant_id, a tenant's rows near each other; large tenants are split among tasks."""
        return self.resolve(df, attributes).hint("rebalance", "tenant_id")


#: What a server has without configuration.
CONFIG_DEFAULT = Resolver("attribute_based", CONFIGURED, DEFAULT)


def normal(tenant: str | None) -> str:
    return tenant or DEFAULT
