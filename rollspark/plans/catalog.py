"""All queries of the library with their SQL oracles, by operator id."""

from __future__ import annotations

from . import clusterings, extraction, files, manifests, metrics, structure, texts  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
