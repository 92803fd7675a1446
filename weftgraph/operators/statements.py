"""Statements that upsert rows in an outside graph store, and a pass-through sink for them.

Graphs are built in Spark without these. For a store with a Spark connector, the sink
hands a projection and its statement to that connector's format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftgraph.config import Connection, NodeMapping, RelationshipMapping
from weftgraph.operators.graph import DST, SRC


def _assignments(owner: str, row: str, names: list[str]) -> str:
    return f" SET {', '.join(f'{owner}.{n} = {row}.{n}' for n in names)}" if names else ""


def node_statement(m: NodeMapping, row: str = "row") -> str:
    """MERGE of a node by its key; other mapped properties are set."""
    names = [n for n in dict.fromkeys(p.target_name for p in m.properties) if n != m.key]
    return f"MERGE (n:{m.label} {{{m.key}: {row}.{m.key}}}){_assignments('n', row, names)}"


def rel_statement(m: RelationshipMapping, row: str = "row") -> str:
    """MERGE of a relationship between nodes that exist."""
    ends = f"MATCH (a:{m.from_label} {{{m.from_key}: {row}.{SRC}}}) MATCH (b:{m.to_label} {{{m.to_key}: {row}.{DST}}})"
    return f"{ends} MERGE (a)-[r:{m.rel_type}]->(b){_assignments('r', row, list(dict.fromkeys(p.target_name for p in m.properties)))}"


def batched(statement: str) -> str:
    """The statement over a list parameter `rows`."""
    return f"UNWIND $rows AS row {statement}"


def connector_options(c: Connection, batch_size: int) -> dict[str, str]:
    options = {"url": c.uri, "database": c.database, "batch.size": str(batch_size)}
    login = {"authentication.type": "basic", "authentication.basic.username": c.username, "authentication.basic.password": c.password}
    return {k: v for k, v in (options | (login if c.username else {})).items() if v}


def write_external(projection: DataFrame, statement: str, fmt: str, connection: Connection, batch_size: int = 5000, partitions: int | None = None) -> None:
    """Hand a projection to a connector; its rows are named `event` in the statement."""
    rows = projection.repartition(partitions) if partitions else projection
    rows.write.format(fmt).options(**connector_options(connection, batch_size)).option("query", statement).mode("Overwrite").save()
