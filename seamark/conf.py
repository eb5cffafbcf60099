"""Engine settings that change results, and the session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def parsed(value: str | None, default):
    """A setting's text as the default's type; the default where it does not parse."""
    if value is None:
        return default
    try:
        if isinstance(default, bool):
            low = value.strip().lower()
            return True if low in ("1", "true", "yes", "on") else False if low in ("0", "false", "no", "off") else default
        return type(default)(value.strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class EngineConf:
    min_width: int = 256
    min_height: int = 256
    min_bytes: int = 1024
    max_bytes: int = 50 * 1024 * 1024
    refresh_days: int = 0
    max_pages: int = 100_000
    domain_budget: int = 100
    flush_interval: int = 100
    frontier_cap: int = 1000
    max_domain_errors: int = 3
    lease_minutes: int = 30
    checkpoint_seconds: int = 2_592_000
    strip_subdomains: bool = False

    @classmethod
    def from_env(cls, prefix: str = "SEAMARK_") -> EngineConf:
        return cls(**{f.name: parsed(os.environ.get(prefix + f.name.upper()), f.default) for f in fields(cls)})


def session(name: str = "seamark", **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive; partitions and memory come from the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
