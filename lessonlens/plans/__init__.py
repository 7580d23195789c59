"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ["rollup_queries", "segment_queries", "intervention_queries", "rating_queries", "agreement_queries", "streaming_queries", "source_queries"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"lessonlens.plans.{name}")
