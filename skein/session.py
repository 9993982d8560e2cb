"""Session and configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def session(name: str = "skein", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword, with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


class ConfigurationError(ValueError):
    """A setting is missing or out of range."""


class ValidationError(ValueError):
    """An input breaks a rule."""


class NotFoundError(LookupError):
    """A row that must exist doesn't."""


class ProviderError(RuntimeError):
    """A model provider failed; ``retryable`` tells whether another try can help."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def from_env(kind: type, prefix: str = ""):
    """An instance of dataclass ``kind`` with fields read from the environment (bool, int, float, str) where set."""
    values = {}
    for f in fields(kind):
        raw = os.environ.get(prefix + f.name.upper())
        if raw is None:
            continue
        base = type(f.default)
        try:
            values[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if base is bool else base(raw)
        except ValueError as e:
            raise ConfigurationError(f"{prefix}{f.name.upper()}={raw!r} isn't {base.__name__}") from e
    return kind(**values)


@dataclass(frozen=True)
class HybridConfig:
    """Hybrid retrieval: results, weights of the two lists, rank constant."""

    top_k: int = 20
    vector_weight: float = 0.5
    keyword_weight: float = 0.5
    rrf_constant: int = 60

    def __post_init__(self):
        if self.vector_weight < 0 or self.keyword_weight < 0:
            raise ConfigurationError("weights must not be negative")
        if not 0.99 <= self.vector_weight + self.keyword_weight <= 1.01:
            raise ConfigurationError("weights must add up to 1")


@dataclass(frozen=True)
class KeywordConfig:
    """Keyword index: where it is kept, and whether tokens are lower-cased."""

    index_path: str = "data/bm25-index"
    tokenize_lowercase: bool = False


@dataclass(frozen=True)
class ExpansionConfig:
    """Context expansion: depth 0 to 2, rows of the result, chunks for a link at depths 1 and 2."""

    depth: int = 1
    max_chunks: int = 30
    per_link_1: int = 2
    per_link_2: int = 1

    def __post_init__(self):
        if self.depth not in (0, 1, 2):
            raise ConfigurationError("depth must be 0, 1 or 2")
        if self.max_chunks < 0:
            raise ConfigurationError("max_chunks must not be negative")
