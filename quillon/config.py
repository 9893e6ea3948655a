"""Configuration: a file, then defaults, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from .functions.tenant import CONFIGURED, DEFAULT, Resolver


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    landing_dir: str = "landing"
    http_address: str = "127.0.0.1:8080"
    retention_days: int = 7
    batch_interval: str = "1 second"
    sweep_hours: float = 6.0
    resolver: Resolver = Resolver("attribute_based", CONFIGURED, DEFAULT)


#: Environment variables and what they set.
ENVIRONMENT = {"QUILLON_DATA_DIR": "data_dir", "QUILLON_LANDING_DIR": "landing_dir", "QUILLON_HTTP_ADDR": "http_address", "QUILLON_RETENTION_DAYS": "retention_days", "QUILLON_BATCH_INTERVAL": "batch_interval"}


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """A JSON file (or YAML, where a parser for it is installed); a missing path means defaults."""
    raw: dict = {}
    if path:
        text = open(path, encoding="utf-8").read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(text) or {}
        else:
            raw = json.loads(text)
    tenant = raw.pop("tenant_resolution", None)
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__}
    if tenant is not None:
        known["resolver"] = Resolver(tenant.get("strategy", ""), tuple(tenant.get("attrs", ())), tenant.get("default", ""))
    env = dict(os.environ) if env is None else env
    for name, field in ENVIRONMENT.items():
        if env.get(name):
            known[field] = int(env[name]) if field == "retention_days" else env[name]
    return Config(**known)
