"""Settings: a YAML-like mapping overlaid by Spark configuration entries."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "spark.graphloom."


@dataclass(frozen=True)
class Settings:
    nodes_path: str = ""
    edges_path: str = ""
    snippets_path: str = ""
    status_path: str = ""
    snapshots_path: str = ""
    embedding_batch: int = 32
    require_confirm_token: bool = False
    confirm_token: str = ""
    enforce_endpoint_rules: bool = False

    @classmethod
    def load(cls, spark: SparkSession, file_values: dict[str, Any] | None = None) -> "Settings":
        """File values first, then ``spark.graphloom.*`` entries on top of them."""
        known = {f.name: f.type for f in fields(cls)}
        merged: dict[str, Any] = {}
        for key, value in _flatten(file_values or {}).items():
            if key in known:
                merged[key] = value
        for key in known:
            value = spark.conf.get(PREFIX + key, None)
            if value is not None:
                merged[key] = value
        return replace(cls(), **{k: _cast(known[k], v) for k, v in merged.items()})


def deep_merge(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """``override`` wins; nested mappings are merged key by key."""
    merged = dict(base)
    for key, value in override.items():
        if isinstance(value, dict) and isinstance(merged.get(key), dict):
            merged[key] = deep_merge(merged[key], value)
        else:
            merged[key] = value
    return merged


def _flatten(values: dict[str, Any]) -> dict[str, Any]:
    flat: dict[str, Any] = {}
    for key, value in values.items():
        if isinstance(value, dict):
            flat.update({f"{key}_{k}": v for k, v in _flatten(value).items()})
        else:
            flat[key] = value
    return flat


def _cast(kind: str, value: Any) -> Any:
    if kind == "bool" and not isinstance(value, bool):
        return str(value).strip().lower() in {"1", "true", "yes", "on"}
    if kind == "int":
        return int(value)
    return value if kind == "bool" else str(value)
