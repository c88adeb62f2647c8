"""Queries over the driver's tables, each with the SQL that should give the same rows."""

from __future__ import annotations

import importlib

from .registry import ENTRIES, Entry

SECTIONS = ["sources", "cleaning", "checks", "joins", "aggregates", "profiles", "windows",
            "matrices", "ranking", "splits", "scoring", "experiments"]


def load() -> dict[str, Entry]:
    for section in SECTIONS:
        importlib.import_module(f"workload.{section}")
    return ENTRIES
