"""Configuration: collections, contexts and the lifecycle policy, from a file or a mapping."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Lifecycle:
    """After how many days documents are archived, by type if overridden, and purged; which collections are exempt."""

    archive_after_days: float = 90
    type_overrides: Mapping[str, float | None] = field(default_factory=dict)
    purge_after_days: float | None = None
    exempt_collections: tuple[str, ...] = ()
    dry_run: bool = True


@dataclass(frozen=True)
class Config:
    """``collections`` by name with path, pattern and contexts by prefix; the context of all; the policy, if there is one."""

    collections: Mapping[str, Mapping] = field(default_factory=dict)
    global_context: str = ""
    lifecycle: Lifecycle | None = None

    def invalid_names(self) -> list[str]:
        """Names that make virtual paths ambiguous: others than letters, digits, ``_`` and ``-``."""
        return [n for n in self.collections if not re.fullmatch(r"[A-Za-z0-9_-]+", n)]

    def collections_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, str(c.get("path", "")), str(c.get("pattern") or "**/*.md")) for n, c in self.collections.items()]
        return spark.createDataFrame(rows, "collection string, path string, pattern string")

    def contexts_table(self, spark: SparkSession) -> DataFrame:
        """(collection, prefix, said); the context of all has no collection and an empty prefix."""
        rows = [(n, str(p).strip("/"), str(said)) for n, c in self.collections.items() for p, said in (c.get("context") or {}).items()]
        if self.global_context:
            rows.append((None, "", self.global_context))
        return spark.createDataFrame(rows, "collection string, prefix string, said string")


def _policy(raw) -> Lifecycle | None:
    if not isinstance(raw, Mapping):
        return None
    number = lambda key, default: raw[key] if isinstance(raw.get(key), int | float) and not isinstance(raw.get(key), bool) else default
    return Lifecycle(
        number("archive_after_days", 90),
        dict(raw["type_overrides"]) if isinstance(raw.get("type_overrides"), Mapping) else {},
        number("purge_after_days", None),
        tuple(raw["exempt_collections"]) if isinstance(raw.get("exempt_collections"), list) else (),
        raw.get("dry_run") is not False,
    )


def from_mapping(raw: Mapping | None) -> Config:
    """A configuration; parts that are missing or of the wrong kind are as if they weren't there."""
    raw = raw or {}
    found = raw.get("collections")
    return Config({str(n): c for n, c in found.items() if isinstance(c, Mapping)} if isinstance(found, Mapping) else {}, str(raw.get("global_context") or ""), _policy(raw.get("lifecycle")))


def load(path: str) -> Config:
    """The configuration in a YAML or JSON file; an empty one if there is no file, ValueError if it can't be parsed."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        raw = json.loads(text) if path.endswith(".json") else _yaml(text)
    except Exception as e:
        raise ValueError(f"{path} can't be parsed: {e}") from e
    if raw is not None and not isinstance(raw, Mapping):
        raise ValueError(f"{path} holds no mapping")
    return from_mapping(raw)


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs a YAML package; JSON needs none") from e
    return yaml.safe_load(text)


def setting(name: str, default: float, low: float | None = None, high: float | None = None, environ: Mapping[str, str] | None = None) -> float:
    """A number from the environment; the default if it is no number or out of bounds."""
    try:
        value = float((os.environ if environ is None else environ)[name])
    except (KeyError, ValueError):
        return default
    fits = value == value and (low is None or value >= low) and (high is None or value <= high)
    return value if fits else default
