"""Jobs from a graph mapping schema: JSON that lists labels, natural keys and properties."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from weftgraph.config import Connection, IdGenerationConfig, IngestConfig, NodeMapping, PropertyMapping, RelationshipMapping, SchemaConstraint, SchemaDefinition, SchemaIndex, SourceConfig
from weftgraph.plans.csv_mapping import TYPES as SHEET_TYPES
from weftgraph.plans.csv_mapping import typed_chain

TYPES = SHEET_TYPES | {"number": "to_float"}
MARKERS = {"$id", "idGeneration", "sourceDefinitions"}


def is_kg_schema(data: dict[str, Any]) -> bool:
    """Whether a parsed document is such a schema: it has a marker, or its first node maps properties by name."""
    if MARKERS & data.keys():
        return True
    nodes = data.get("nodes")
    first = nodes[0] if isinstance(nodes, list) and nodes else None
    return isinstance(first, dict) and "label" in first and isinstance(first.get("properties"), dict)


def _either(d: dict[str, Any], default: Any, *names: str) -> Any:
    return next((d[n] for n in names if n in d), default)


def _properties(defined: dict[str, Any]) -> list[PropertyMapping]:
    out = []
    for target, d in defined.items():
        d = {"sourceField": d} if isinstance(d, str) else d
        field = _either(d, target, "sourceField", "source_field")
        out.append(PropertyMapping(source_field=field, target=target if target != field else None, transform=typed_chain(d.get("type", "string"), d.get("transforms", []), TYPES)))
    return out


def _ids(d: dict[str, Any], fields: list[str]) -> IdGenerationConfig:
    return IdGenerationConfig(strategy=d.get("strategy", "sha256-hash"), fields=fields, hash_length=_either(d, 16, "hashLength", "hash_length"), separator=d.get("separator", ":"), prefix=d.get("prefix", ""))


def _key(d: dict[str, Any], properties: list[PropertyMapping]) -> str:
    """The key of a node without natural key: named, else first required, else first, else id."""
    if "key" in d:
        return d["key"]
    required = [n for n, p in d.get("properties", {}).items() if isinstance(p, dict) and p.get("required")]
    return (required or [p.target_name for p in properties] or ["id"])[0]


def _node(d: dict[str, Any], ids: dict[str, Any], source: str) -> NodeMapping:
    properties, natural = _properties(d.get("properties", {})), d.get("naturalKey", [])
    return NodeMapping(
        source=d.get("source", source),
        label=d["label"],
        key=d.get("idField", "_id") if natural else _key(d, properties),
        properties=properties,
        id_generation=_ids(d.get("idGeneration") or ids, natural) if natural else None,
    )


def _relationship(d: dict[str, Any], source: str) -> RelationshipMapping:
    from_key, to_key = _either(d, "_id", "fromKey", "from_key"), _either(d, "_id", "toKey", "to_key")
    return RelationshipMapping(
        source=d.get("source", source),
        rel_type=d["type"],
        from_label=_either(d, "", "fromNode", "from_label"),
        from_key=from_key,
        from_field=_either(d, from_key, "fromField", "from_field"),
        to_label=_either(d, "", "toNode", "to_label"),
        to_key=to_key,
        to_field=_either(d, to_key, "toField", "to_field"),
        properties=_properties(d.get("properties", {})),
    )


def _source(name: str, d: dict[str, Any]) -> SourceConfig:
    said = d.get("dataFormat", "").lower()
    kind = next((k for k in ("csv", "json", "sql") if k in said), "json")
    path = (d.get("examples") or [f"{name}_data.json"])[0]
    return SourceConfig(name=name, type=kind, path=path)


def from_dict(raw: dict[str, Any], *, sources: list[dict[str, Any]] | None = None, connection: dict[str, Any] | None = None, settings: dict[str, Any] | None = None) -> IngestConfig:
    """A job from a parsed schema; every node key gets a unique constraint and a range index."""
    defined = raw.get("sourceDefinitions", {})
    first = next(iter(defined), "default")
    nodes = [_node(d, raw.get("idGeneration") or {}, first) for d in raw.get("nodes", [])]
    rels = [_relationship(d, first) for d in raw.get("relationships", [])]
    names = {*defined, *(m.source for m in [*nodes, *rels])}
    return IngestConfig(
        connection=Connection(**(connection or {})),
        settings=settings or {},
        sources=[SourceConfig.model_validate(s) for s in sources] if sources else [_source(n, defined.get(n, {})) for n in sorted(names)],
        nodes=nodes,
        relationships=rels,
        graph_schema=SchemaDefinition(constraints=[SchemaConstraint(label=n.label, property=n.key) for n in nodes], indexes=[SchemaIndex(label=n.label, properties=[n.key]) for n in nodes]),
    )


def load_kg_schema(path: str | Path, **overrides: Any) -> IngestConfig:
    return from_dict(json.loads(Path(path).read_text(encoding="utf-8")), **overrides)
