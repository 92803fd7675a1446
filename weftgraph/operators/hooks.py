"""Hooks around a load: callables, Spark SQL, and three shapes of Cypher.

Recognised shapes set a property of a label from its relationships: a degree by pattern
comprehension (0 where there are none), a count, and an average of a relationship
property (both leave nodes without relationships as they are). Any other Cypher is
reported as external and not run.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import SchemaHook
from weftgraph.functions.pyvalues import column
from weftgraph.operators.graph import DST, SRC, Nodes, PropertyGraph, one_type

log = logging.getLogger(__name__)

_DEGREE = re.compile(r"^\s*MATCH\s*\((\w+):(\w+)\)\s*SET\s+\1\.(\w+)\s*=\s*size\(\s*\[\s*\((\w*)\)(<?)-\[:(\w+)\]-(>?)\((\w*)\)\s*\|\s*\w+\s*\]\s*\)\s*;?\s*$", re.I)
_GROUPED = re.compile(r"^\s*MATCH\s*\((\w+):(\w+)\)(<?)-\[(\w+):(\w+)\]-(>?)\(\w*(?::\w+)?\)\s*WITH\s+\1\s*,\s*(count|avg)\(\4(?:\.(\w+))?\)\s+AS\s+(\w+)\s*SET\s+\1\.(\w+)\s*=\s*\9\s*;?\s*$", re.I)


def set_from_rels(graph: PropertyGraph, label: str, target: str, rel_type: str, value: Column, incoming: bool = True, missing: object = None) -> None:
    """Set `target` of a label's nodes to an aggregate over their relationships of a type.

    Nodes without any keep the property they had, or take `missing`.
    """
    if label not in graph.nodes:
        log.warning("no nodes of label %s; %s is not set", label, target)
        return
    nodes = graph.nodes[label]
    end, at = (DST, 2) if incoming else (SRC, 1)
    found = [df for k, df in graph.rels.items() if k[0] == rel_type and k[at] == label]
    if not found:
        grouped = nodes.df.select(F.col(f"`{nodes.key}`").alias("__k"), F.lit(None).cast("long").alias("__v")).limit(0)
    else:
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        grouped = rows.groupBy(F.col(end).alias("__k")).agg(value.alias("__v"))
    old = column(nodes.df, target)
    kept = F.lit(missing) if missing is not None else old if target in nodes.df.columns else F.lit(None)
    out = nodes.df.join(grouped, F.col(f"`{nodes.key}`") == F.col("__k"), "left").withColumn(target, F.coalesce("__v", kept)).drop("__k", "__v")
    graph.nodes[label] = Nodes(out, nodes.key, mixed=nodes.mixed)


def set_from_rows(graph: PropertyGraph, label: str, rows: DataFrame) -> None:
    """Set properties of a label's nodes from rows of (key, properties), one row a key.

    Nodes that no row names keep what they had; two rows with one key are an error.
    """
    nodes = graph.nodes[label]
    names = [c for c in rows.columns if c != nodes.key]
    if nodes.key not in rows.columns:
        raise ValueError(f"a hook for label {label} must return its key '{nodes.key}'")
    before, rows = one_type([nodes.df, rows])
    one = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(F.lit(True).alias("__hit"), *[F.col(f"`{n}`") for n in names])))
    twice = F.raise_error(F.concat(F.lit(f"a hook for label {label} returns several rows for "), F.first(F.col(f"`{nodes.key}`").cast("string"))))
    found = rows.groupBy(F.col(f"`{nodes.key}`").alias("__key")).agg(one.otherwise(twice).alias("__new"))
    hit = F.col("__new").isNotNull()
    taken = {n: F.when(hit, F.col("__new")[n]).otherwise(column(before, n)) for n in names}
    out = before.join(found, F.col(f"`{nodes.key}`") == F.col("__key"), "left").withColumns(taken).drop("__key", "__new")
    graph.nodes[label] = Nodes(out, nodes.key, mixed=nodes.mixed)


def degree(graph: PropertyGraph, label: str, target: str, rel_type: str, incoming: bool = True) -> None:
    set_from_rels(graph, label, target, rel_type, F.count(F.lit(1)), incoming, missing=0)


def run_cypher(graph: PropertyGraph, text: str) -> bool:
    """Run a recognised statement; False for any other."""
    if m := _DEGREE.match(text):
        bound, label, target, first, left, rel_type, right, second = m.groups()
        if bound not in (first, second) or first == second or bool(left) == bool(right):
            return False
        degree(graph, label, target, rel_type, incoming=bool(right) == (bound == second))
        return True
    if m := _GROUPED.match(text):
        _, label, left, _, rel_type, right, fn, prop, _, target = m.groups()
        if fn.lower() == "avg" and not prop:
            return False
        known = any(t == rel_type for t, _, _ in graph.rels)  # a type without relationships matches nothing
        x = column(graph.rel(rel_type), prop) if prop and known else F.lit(1)
        value = F.count(x) if fn.lower() == "count" else F.avg(x.cast("double"))
        set_from_rels(graph, label, target, rel_type, value, incoming=bool(left) and not right)
        return True
    return False


def run_hook(graph: PropertyGraph, hook: SchemaHook | Callable[[PropertyGraph], PropertyGraph | None], spark: SparkSession | None = None) -> PropertyGraph:
    """Run one hook; SQL sees views node_<Label> and rel_<TYPE>, and with `label` returns (key, new properties).

    SQL without a label is run for what it does, such as making a view.
    """
    if callable(hook):
        return hook(graph) or graph
    log.info("hook: %s", hook.description or hook.cypher[:60] or (hook.sql or "")[:60])
    if hook.sql:
        graph.register_views()
        rows = (spark or SparkSession.active()).sql(hook.sql)
        if hook.label and hook.label not in graph.nodes:
            log.warning("no nodes of label %s; the hook sets nothing", hook.label)
        elif hook.label:
            set_from_rows(graph, hook.label, rows)
    elif hook.cypher and not run_cypher(graph, hook.cypher):
        log.warning("external statement, not run: %s", hook.cypher[:60])
    return graph
