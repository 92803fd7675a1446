"""weftgraph: a Spark-native, config-driven property-graph builder."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Public names and their modules; loaded on first use, as Python workers import the package too.
_EXPORTS = {
    "IngestConfig": "config",
    "load_config": "config",
    "load_csv_mapping": "plans.csv_mapping",
    "load_kg_schema": "plans.kg_schema",
    "IngestResult": "plans.engine",
    "run": "plans.engine",
    "run_from_file": "plans.engine",
    "validate_config": "plans.engine",
    "PropertyGraph": "operators.graph",
    "read_source": "sources",
    "source_registry": "registry",
    "transform_registry": "registry",
}


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"weftgraph.{_EXPORTS[name]}"), name)
