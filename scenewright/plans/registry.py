"""All registered queries, by name."""

from __future__ import annotations

import importlib

MODULES = ["grids", "platformer", "other_games", "captions", "metrics", "runs", "streams", "files", "sketches"]


def registered() -> dict[str, tuple]:
    """``{name: (callable, check SQL or None)}``."""
    out: dict[str, tuple] = {}
    for module in MODULES:
        out.update(importlib.import_module(f"scenewright.plans.{module}").QUERIES)
    return out
