"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("counters", "people", "cascades", "corpus", "formulas")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
