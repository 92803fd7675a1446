"""Schema constraints as queries that must find nothing, and index layouts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.config import SchemaConstraint, SchemaDefinition, SchemaIndex
from weftgraph.functions.pyvalues import column
from weftgraph.operators.graph import PropertyGraph

SORTED = ("range", "btree")


_CONSTRAINT = re.compile(r"^\s*CREATE\s+CONSTRAINT\s+(?:(\w+)\s+)??(?:IF\s+NOT\s+EXISTS\s+)?FOR\s*\(\w+:(\w+)\)\s*REQUIRE\s*\(?([\w.,\s]+?)\)?\s+IS\s+(UNIQUE|NOT\s+NULL|NODE\s+KEY)\s*;?\s*$", re.I)
_INDEX = re.compile(r"^\s*CREATE\s+(?:(TEXT|RANGE|POINT|FULLTEXT)\s+)?INDEX\s+(?:(\w+)\s+)??(?:IF\s+NOT\s+EXISTS\s+)?FOR\s*\(\w+:(\w+)\)\s*ON\s*(?:EACH\s*)?[(\[]([\w.,\s]+)[)\]]\s*;?\s*$", re.I)


def parse_ddl(text: str) -> SchemaConstraint | SchemaIndex | None:
    """A constraint or index from its statement, as hooks may hold them; None for any other text."""
    names = lambda refs: [r.strip().split(".")[-1] for r in refs.split(",")]
    if m := _CONSTRAINT.match(text):
        name, label, refs, kind = m.groups()
        kind = {"UNIQUE": "unique", "NOT NULL": "exists", "NODE KEY": "node_key"}[" ".join(kind.upper().split())]
        return SchemaConstraint(label=label, property=names(refs), type=kind, name=name)
    if m := _INDEX.match(text):
        kind, name, label, refs = m.groups()
        return SchemaIndex(label=label, properties=names(refs), type=(kind or "btree").lower(), name=name)
    return None


class ConstraintViolation(ValueError):
    """A graph breaks a constraint."""


def violations(df: DataFrame, c: SchemaConstraint) -> DataFrame:
    """unique: (properties, n) shared by n > 1 nodes; exists: nodes without; node_key: both as (properties, n)."""
    props = [column(df, p).alias(p) for p in c.properties]
    if c.type == "exists":
        return df.where(column(df, c.properties[0]).isNull())
    rows = df.select(*props)
    nulls = [F.col(f"`{p}`").isNull() for p in c.properties]
    any_null = F.array_contains(F.array(*nulls), True)
    if c.type == "unique":
        rows = rows.where(~any_null)
        return rows.groupBy(*c.properties).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.groupBy(*c.properties).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | any_null)


def enforce(graph: PropertyGraph, schema: SchemaDefinition) -> None:
    """Raise at the first constraint that does not hold; labels without nodes hold any."""
    for c in schema.constraints:
        nodes = graph.nodes.get(c.label)
        if nodes is None or c.type == "unique" and c.properties == [nodes.key]:
            continue  # a merge makes its key unique
        found = violations(nodes.df, c).limit(3).collect()
        if found:
            raise ConstraintViolation(f"{c.constraint_name}: {c.type} on {c.label}.{c.properties} is broken, e.g. by {found[0].asDict()}")


def layout(schema: SchemaDefinition) -> dict[str, list[str]]:
    """Sort columns for files of a label, from its first range index; other kinds are metadata only."""
    out: dict[str, list[str]] = {}
    for i in schema.indexes:
        if i.type in SORTED:
            out.setdefault(i.label, i.properties)
    return out
