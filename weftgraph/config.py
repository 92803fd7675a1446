"""The configuration of a job, and the three ways to write it down."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, model_validator

from weftgraph.env import resolve

log = logging.getLogger(__name__)


class Connection(BaseModel):
    """An outside graph store, for a pass-through sink; graphs are built without one."""

    uri: str = "bolt://localhost:7687"
    username: str = ""
    password: str = ""
    database: str = ""
    max_connection_pool_size: int = 100
    connection_acquisition_timeout: float = 60.0
    encrypted: bool = False


class RateLimitConfig(BaseModel):
    requests_per_second: float = 10.0
    burst: int = 1


class PaginationConfig(BaseModel):
    type: Literal["offset", "cursor", "page"] = "offset"
    page_param: str = "page"
    page_size_param: str = "per_page"
    page_size: int = 100
    max_pages: int = 1000
    cursor_field: str | None = None
    next_cursor_path: str | None = None


#: Fields that a source of a type cannot do without.
REQUIRED = {"csv": ("path",), "json": ("path",), "sql": ("connection_string", "query"), "rest": ("url",)}


class SourceConfig(BaseModel):
    name: str
    type: str
    path: str | None = None
    encoding: str = "utf-8"
    delimiter: str = ","
    connection_string: str | None = None
    query: str | None = None
    chunk_size: int | None = None
    url: str | None = None
    method: str = "GET"
    headers: dict[str, str] = Field(default_factory=dict)
    params: dict[str, Any] = Field(default_factory=dict)
    body: Any = None
    timeout: float = 60.0
    rate_limit: RateLimitConfig | None = None
    pagination: PaginationConfig | None = None
    json_root: str | None = None
    limit: int | None = None

    @model_validator(mode="after")
    def _complete(self) -> SourceConfig:
        needed = REQUIRED.get(self.type, ())
        if any(not getattr(self, n) for n in needed):
            raise ValueError(f"{self.type.upper()} source requires {' and '.join(map(repr, needed))}")
        return self


class TransformConfig(BaseModel):
    type: str
    params: dict[str, Any] = Field(default_factory=dict)


class ValidationRuleConfig(BaseModel):
    field: str
    rule: str
    params: dict[str, Any] = Field(default_factory=dict)
    message: str | None = None


class ValidationConfig(BaseModel):
    rules: list[ValidationRuleConfig] = Field(default_factory=list)
    on_error: Literal["skip", "fail", "dead_letter"] = "skip"


class PropertyMapping(BaseModel):
    source_field: str
    target: str | None = None
    transform: TransformConfig | list[TransformConfig] | None = None

    @property
    def target_name(self) -> str:
        return self.target or self.source_field

    @property
    def chain(self) -> list[TransformConfig]:
        t = self.transform
        return [] if t is None else t if isinstance(t, list) else [t]


class IdGenerationConfig(BaseModel):
    strategy: Literal["sha256-hash", "composite", "passthrough"] = "sha256-hash"
    fields: list[str] = Field(default_factory=list)
    hash_length: int = 16
    separator: str = ":"
    prefix: str = ""


class NodeMapping(BaseModel):
    source: str
    label: str
    key: str
    properties: list[PropertyMapping] = Field(default_factory=list)
    id_generation: IdGenerationConfig | None = None
    validation: ValidationConfig | None = None


class RelationshipMapping(BaseModel):
    source: str
    rel_type: str
    from_label: str
    from_key: str
    from_field: str
    to_label: str
    to_key: str
    to_field: str
    properties: list[PropertyMapping] = Field(default_factory=list)
    validation: ValidationConfig | None = None


class SchemaHook(BaseModel):
    """A statement around the load: Cypher of a recognised shape, or Spark SQL (see operators.hooks)."""

    cypher: str = ""
    description: str = ""
    sql: str | None = None
    label: str | None = None


def _refs(properties: list[str]) -> str:
    return ", ".join(f"n.{p}" for p in properties)


class SchemaConstraint(BaseModel):
    label: str
    property: str | list[str]
    type: Literal["unique", "exists", "node_key"] = "unique"
    name: str | None = None

    @property
    def properties(self) -> list[str]:
        return [self.property] if isinstance(self.property, str) else self.property

    @property
    def constraint_name(self) -> str:
        return self.name or "_".join([self.label.lower(), *self.properties, self.type])

    def to_cypher(self) -> str:
        demand = {"unique": f"({_refs(self.properties)}) IS UNIQUE", "exists": f"{_refs(self.properties[:1])} IS NOT NULL", "node_key": f"({_refs(self.properties)}) IS NODE KEY"}
        return f"CREATE CONSTRAINT {self.constraint_name} IF NOT EXISTS FOR (n:{self.label}) REQUIRE {demand[self.type]}"


class SchemaIndex(BaseModel):
    label: str
    properties: list[str]
    type: Literal["btree", "text", "range", "point", "fulltext"] = "range"
    name: str | None = None

    @property
    def index_name(self) -> str:
        return self.name or "_".join(["idx", self.label.lower(), *self.properties])

    def to_cypher(self) -> str:
        kind = "" if self.type == "btree" else f"{self.type.upper()} "
        on = f"EACH [{_refs(self.properties)}]" if self.type == "fulltext" else f"({_refs(self.properties)})"
        return f"CREATE {kind}INDEX {self.index_name} IF NOT EXISTS FOR (n:{self.label}) ON {on}"


class SchemaDefinition(BaseModel):
    constraints: list[SchemaConstraint] = Field(default_factory=list)
    indexes: list[SchemaIndex] = Field(default_factory=list)

    def to_hooks(self) -> list[SchemaHook]:
        """The statements, constraints first."""
        return [SchemaHook(cypher=c.to_cypher(), description=f"{c.type} constraint on {c.label}.{c.property}") for c in self.constraints] + [
            SchemaHook(cypher=i.to_cypher(), description=f"{i.type} index on {i.label}.{i.properties}") for i in self.indexes
        ]


class SparkSettings(BaseModel):
    app_name: str = "weftgraph"
    master: str | None = None
    partitions: int | None = None
    spark_config: dict[str, str] = Field(default_factory=dict)
    connector_batch_size: int = 5000

    @model_validator(mode="before")
    @classmethod
    def _any_connector(cls, data: Any) -> Any:
        """One number <store>_connector_batch_size is taken as connector_batch_size; other unknown keys are ignored."""
        if isinstance(data, dict) and "connector_batch_size" not in data:
            named = [k for k, v in data.items() if k.count("_") == 3 and k.endswith("_connector_batch_size") and isinstance(v, int)]
            if len(named) == 1:
                return {k: v for k, v in data.items() if k != named[0]} | {"connector_batch_size": data[named[0]]}
        return data


class JobSettings(BaseModel):
    batch_size: int = 500
    parallel_sources: bool = False
    max_workers: int = 4
    health_check: bool = True
    retry_max_attempts: int = 3
    retry_base_delay: float = 1.0
    continue_on_source_error: bool = False
    metrics_output: str | None = None
    execution_mode: Literal["standard", "spark"] = "standard"
    spark: SparkSettings = Field(default_factory=SparkSettings)
    #: Where the graph is kept; a second run merges into what is there.
    output_path: str | None = None
    #: A connector's data source name: projections are also handed to it with their statements.
    external_format: str | None = None
    #: Seconds between reports of the tasks that are done; none by default.
    progress_seconds: float | None = None
    coerce_endpoints: bool = False
    strict_keys: bool = False


class IngestConfig(BaseModel):
    model_config = ConfigDict(populate_by_name=True)

    connection: Connection = Field(default_factory=Connection)
    settings: JobSettings = Field(default_factory=JobSettings)
    sources: list[SourceConfig]
    nodes: list[NodeMapping]
    relationships: list[RelationshipMapping] = Field(default_factory=list)
    graph_schema: SchemaDefinition | None = Field(default=None, alias="schema")
    pre_hooks: list[SchemaHook] = Field(default_factory=list)
    post_hooks: list[SchemaHook] = Field(default_factory=list)

    @model_validator(mode="before")
    @classmethod
    def _any_connection(cls, data: Any) -> Any:
        """A connection block may be named after its store: the one unknown block that has a uri and nothing but a connection's fields.

        Any other unknown key is ignored.
        """
        if isinstance(data, dict) and "connection" not in data:
            known = {*cls.model_fields, "schema"}
            found = [k for k, v in data.items() if k not in known and isinstance(v, dict) and "uri" in v and v.keys() <= Connection.model_fields.keys()]
            if len(found) == 1:
                return {n: x for n, x in data.items() if n != found[0]} | {"connection": data[found[0]]}
        return data

    @model_validator(mode="after")
    def _references(self) -> IngestConfig:
        names = [s.name for s in self.sources]
        if twice := {n for n in names if names.count(n) > 1}:
            log.warning("sources share a name, the last counts: %s", sorted(twice))
        for kind, mappings in (("Node", self.nodes), ("Relationship", self.relationships)):
            for m in mappings:
                if m.source not in names:
                    raise ValueError(f"{kind} mapping references unknown source '{m.source}'")
        for m in self.nodes:
            targets = {p.target_name for p in m.properties}
            if len({t.lower() for t in targets}) != len(targets):
                raise ValueError(f"properties of '{m.label}' differ in case only")
        return self


def parse(path: Path) -> Any:
    """YAML or JSON by suffix; anything else is tried as YAML, then as JSON."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        if path.suffix in (".yaml", ".yml"):
            raise
        return json.loads(text)


def load_config(path: str | Path) -> IngestConfig:
    """A job from YAML or JSON, from a mapping sheet (.csv) or from a graph mapping schema.

    Environment references are resolved in YAML and JSON jobs only.
    """
    from weftgraph.plans import csv_mapping, kg_schema

    path = Path(path)
    if path.suffix == ".csv":
        return csv_mapping.load_csv_mapping(path)
    raw = parse(path)
    if isinstance(raw, dict) and kg_schema.is_kg_schema(raw):
        return kg_schema.from_dict(raw)
    return IngestConfig.model_validate(resolve(raw))
