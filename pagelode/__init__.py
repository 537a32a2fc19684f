"""Evidence retrieval and corpus preparation as Spark plans."""

from __future__ import annotations

from typing import Any

__version__ = "0.2.0"

#: What the package offers by name, and where it is; modules are loaded when they are asked for.
_PLACES = {
    "prepare": "plans.runs",
    "build_annotations": "plans.runs",
    "run_retrieval": "plans.runs",
    "evaluate_run": "plans.runs",
    "verify_run": "plans.runs",
    "export_table": "plans.runs",
    "retrieve": "operators.retrieval",
    "read_dataset": "sources.readers",
    "sentence_encoder": "sources.readers",
}
__all__ = ["__version__", *_PLACES]


def __getattr__(name: str) -> Any:
    if name not in _PLACES:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
