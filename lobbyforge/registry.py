"""All queries of the engine; importing the plans registers them."""

from __future__ import annotations

from .catalog import ORACLES, QUERIES
from .plans import catalogue, core, flows, items, merging, more, ops, pages, served, service, storage, texts, variants  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
