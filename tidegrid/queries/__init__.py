"""Registered queries, each a whole-table run of library operators."""

from __future__ import annotations

import importlib

MODULES = ["rolling", "joining", "tables", "events_futures", "packs", "sourcing", "forecasting", "anomalies", "streams", "learning", "whole"]


def load_all():
    from tidegrid.queries.registry import REGISTRY

    for m in MODULES:
        importlib.import_module(f"tidegrid.queries.{m}")
    return REGISTRY
