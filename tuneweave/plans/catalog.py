"""All registered queries: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = ("q_tokens", "q_order", "q_adapters", "q_features", "q_trainlog", "q_rollouts", "q_stream", "q_prepare",
            "q_flows", "q_surface")


def registry() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        for name, spec in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query name {name}")
            out[name] = spec
    return out
