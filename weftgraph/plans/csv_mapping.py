"""Jobs from a mapping sheet: one CSV row for each property or relationship."""

from __future__ import annotations

import csv
import logging
from pathlib import Path
from typing import Any

from weftgraph.config import Connection, IngestConfig, NodeMapping, PropertyMapping, RelationshipMapping, SchemaConstraint, SchemaDefinition, SourceConfig, TransformConfig

log = logging.getLogger(__name__)

#: Declared types and the transform that each stands for; other types stand for none.
TYPES = {"int": "to_int", "integer": "to_int", "float": "to_float", "bool": "to_bool", "boolean": "to_bool", "datetime": "to_datetime", "date": "to_datetime"}
YES = {"true", "yes", "1", "x"}


def typed_chain(declared: str, named: list[Any], types: dict[str, str]) -> list[TransformConfig] | None:
    """The declared type's transform first, then those named."""
    first = [TransformConfig(type=types[declared.lower()])] if declared.lower() in types else []
    rest = [TransformConfig(type=t) if isinstance(t, str) else TransformConfig(type=t["type"], params=t.get("params", {})) for t in named]
    return [*first, *rest] or None


def _rows(path: Path) -> list[dict[str, str]]:
    with path.open(newline="", encoding="utf-8") as f:
        return [{k.strip().lower().replace(" ", "_"): (v or "").strip() for k, v in row.items() if k} for row in csv.DictReader(f)]


def _relationship(row: dict[str, str], many: bool) -> RelationshipMapping | None:
    entity, column, target = row["source_entity"], row["source_column"], row.get("target_entity", "")
    if not target:
        log.warning("relationship on %s.%s has no target entity; it is skipped", entity, column)
        return None
    named = f"HAS_{target.upper()}" if many else f"BELONGS_TO_{entity.upper()}"
    return RelationshipMapping(
        source=entity,
        rel_type=row.get("relationship_type") or named,
        from_label=entity,
        from_key=row.get("rel_source_key") or column,
        from_field=column,
        to_label=target,
        to_key=row.get("rel_target_key") or row.get("target_column") or column,
        to_field=column,
    )


def load_csv_mapping(
    path: str | Path,
    *,
    sources: list[dict[str, Any]] | None = None,
    connection: dict[str, Any] | None = None,
    settings: dict[str, Any] | None = None,
    auto_schema: bool = True,
) -> IngestConfig:
    """A job from a mapping sheet.

    Rows of cardinality 1:1 are properties of target_entity (by default the source
    entity), rows of 1:M and M:1 are relationships, other rows are ignored. The last
    column marked is_key is the key, else the first property. Without `sources`, each
    entity reads <entity>.csv.
    """
    properties: dict[tuple[str, str], list[PropertyMapping]] = {}
    keys: dict[tuple[str, str], str] = {}
    unique: list[tuple[str, str]] = []
    rels, entities = [], set()
    for row in _rows(Path(path)):
        entity, column = row.get("source_entity", ""), row.get("source_column", "")
        if not entity or not column:
            log.warning("a row without source entity or column is skipped")
            continue
        entities.add(entity)
        kind = (row.get("field_cardinality") if "field_cardinality" in row else "1:1").upper()
        if kind == "1:1":
            label, target = row.get("target_entity") or entity, row.get("target_column") or column
            chain = typed_chain(row.get("data_type", ""), [t.strip() for t in row.get("transform", "").split(",") if t.strip()], TYPES)
            properties.setdefault((entity, label), []).append(PropertyMapping(source_field=column, target=target if target != column else None, transform=chain))
            if row.get("is_key", "").lower() in YES:
                keys[entity, label] = target
                unique.append((label, target))
        elif kind in ("1:M", "M:1") and (rel := _relationship(row, kind == "1:M")):
            rels.append(rel)
    nodes = []
    for (entity, label), found in sorted(properties.items(), key=lambda x: [e for e, _ in properties].index(x[0][0])):
        if (entity, label) not in keys:
            log.warning("%s has no key; its first property %s is taken", label, found[0].target_name)
        nodes.append(NodeMapping(source=entity, label=label, key=keys.get((entity, label), found[0].target_name), properties=found))
    labels = {n.label for n in nodes}
    for r in rels:
        for label in {r.from_label, r.to_label} - labels:
            log.warning("relationship %s refers to label %s, which no mapping makes", r.rel_type, label)
    return IngestConfig(
        connection=Connection(**(connection or {})),
        settings=settings or {},
        sources=[SourceConfig.model_validate(s) for s in sources] if sources else [SourceConfig(name=e, type="csv", path=f"{e}.csv") for e in sorted(entities)],
        nodes=nodes,
        relationships=rels,
        graph_schema=SchemaDefinition(constraints=[SchemaConstraint(label=n, property=p) for n, p in unique]) if auto_schema and unique else None,
    )
