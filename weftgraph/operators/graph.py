"""Projection of rows to nodes and relationships, and their merge into a graph.

MERGE is a grouped aggregate: one row a key, each property from the last row of a mapping
that owns it. Relationships are two equi-joins with node keys, then the same aggregate.
"""

from __future__ import annotations

import logging
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.config import NodeMapping, PropertyMapping, RelationshipMapping
from weftgraph.functions.ids import generate_id
from weftgraph.functions.pyvalues import column, pystr, type_of
from weftgraph.functions.transforms import apply_chain
from weftgraph.sources.paths import reads_files, table_at

log = logging.getLogger(__name__)

SEQ, ORD = "__seq", "__ord"
SRC, DST = "from_val", "to_val"


def with_sequence(df: DataFrame) -> DataFrame:
    """`df` with the place of each row in its source: by file, then by row; else by partition."""
    if SEQ in df.columns:
        return df
    row = F.monotonically_increasing_id()
    if reads_files(df):
        return df.withColumn(SEQ, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), row.alias("r")))
    return df.withColumn(SEQ, F.struct(F.lit("").alias("f"), F.lit(0).cast("long").alias("b"), row.alias("r")))


def _mapped(df: DataFrame, properties: Sequence[PropertyMapping]) -> dict[str, Column]:
    out = {}
    for p in properties:
        if p.source_field not in df.columns:
            log.warning("source has no column '%s'; it counts as null", p.source_field)
        out[p.target_name] = apply_chain(df, column(df, p.source_field), p.chain)  # a later one wins
    return out


def _select(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    kept = [SEQ] if SEQ in df.columns else []
    return df.select(*[c.alias(n) for n, c in cols.items()], *kept)


def project_nodes(df: DataFrame, m: NodeMapping) -> DataFrame:
    """Mapped properties and the key: generated, mapped, or the raw column of that name."""
    cols = _mapped(df, m.properties)
    if m.id_generation is not None:
        cols[m.key] = generate_id(df, m.id_generation)
    elif m.key not in cols:
        cols[m.key] = column(df, m.key)
    return _select(df, cols)


def project_rels(df: DataFrame, m: RelationshipMapping) -> DataFrame:
    """from_val and to_val, untransformed, and the mapped properties."""
    cols = {SRC: column(df, m.from_field), DST: column(df, m.to_field)} | _mapped(df, m.properties)
    return _select(df, cols)


def merge(rows: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row for each combination of keys over several projections, in mapping order.

    A property takes its last assigned value, null included, among the rows of the
    projections that have it. Rows with a null key are left out.
    """
    rows = [with_sequence(r) for r in rows]
    owners: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for c in r.columns:
            if c not in (*keys, SEQ):
                owners.setdefault(c, []).append(i)
    rows = one_type(rows)
    tagged = [r.withColumn(ORD, F.lit(i)) for i, r in enumerate(rows)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    every = every.where(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys]))
    by = [F.col(f"`{k}`") for k in keys]
    if not owners:
        return every.select(*by).distinct()
    at = F.struct(ORD, SEQ)
    groups: dict[tuple[int, ...], list[str]] = {}
    for c, own in owners.items():
        groups.setdefault(tuple(own), []).append(c)
    aggs = []
    for g, (own, names) in enumerate(groups.items()):
        order = at if len(own) == len(rows) else F.when(F.col(ORD).isin(list(own)), at)
        aggs.append(F.max_by(F.struct(*[F.col(f"`{n}`") for n in names]), order).alias(f"__g{g}"))
    merged = every.groupBy(*by).agg(*aggs)
    where = {n: f"__g{g}" for g, names in enumerate(groups.values()) for n in names}
    return merged.select(*by, *[F.col(where[n])[n].alias(n) for n in owners])


def one_type(rows: list[DataFrame]) -> list[DataFrame]:
    """Columns whose types differ between projections become text, as untyped values would mix."""
    kinds: dict[str, set] = {}
    for r in rows:
        for f in r.schema:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {n for n, k in kinds.items() if len(k) > 1 and n != SEQ and not all(isinstance(t, T.NumericType) for t in k)}
    if mixed:
        log.warning("columns %s have several types and become text", sorted(mixed))
    return [r.withColumns({f.name: pystr(F.col(f"`{f.name}`"), f.dataType) for f in r.schema if f.name in mixed}) for r in rows]


def _family(kind: T.DataType) -> type:
    return next((k for k in (T.NumericType, T.StringType, T.BooleanType) if isinstance(kind, k)), type(kind))


@dataclass
class Nodes:
    """Merged nodes; `found`, where it is known, are unmerged rows that hold the same keys."""

    df: DataFrame
    key: str
    found: DataFrame | None = None
    #: Mappings merge the label by several keys, so `key` may be null or repeat.
    mixed: bool = False

    @property
    def keys(self) -> DataFrame:
        """The distinct keys: a smaller plan than that of the merge, which need not run for them."""
        if self.mixed:
            return self.df.select(self.key).where(F.col(f"`{self.key}`").isNotNull())
        return self.df.select(self.key) if self.found is None else self.found.where(F.col(f"`{self.key}`").isNotNull()).distinct()


@dataclass
class PropertyGraph:
    """Merged nodes by label and relationships by (type, from label, to label); all lazy."""

    nodes: dict[str, Nodes] = field(default_factory=dict)
    rels: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)

    def rel(self, rel_type: str) -> DataFrame:
        """All relationships of a type."""
        found = [df for (t, _, _), df in self.rels.items() if t == rel_type]
        if not found:
            raise KeyError(rel_type)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def register_views(self) -> None:
        """Temporary views node_<Label> and rel_<TYPE>."""
        for label, n in self.nodes.items():
            n.df.createOrReplaceTempView(f"node_{label}")
        for t in {t for t, _, _ in self.rels}:
            self.rel(t).createOrReplaceTempView(f"rel_{t}")

    def write_nodes(self, label: str, path: str, order: Sequence[str] = ()) -> None:
        """One label as Parquet, sorted by `order` if that is given."""
        df = self.nodes[label].df
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")

    def write_rels(self, at: tuple[str, str, str], path: str) -> None:
        self.rels[at].write.mode("overwrite").parquet(f"{path}/rels/{at[0]}/{at[1]}-{at[2]}")

    def write(self, path: str, layout: dict[str, list[str]] | None = None) -> None:
        """A Parquet table for each label and relationship; `layout` names sort columns by label."""
        for label in self.nodes:
            self.write_nodes(label, path, (layout or {}).get(label, ()))
        for at in self.rels:
            self.write_rels(at, path)

    @staticmethod
    def read(spark: SparkSession, path: str, nodes: dict[str, str], rels: Sequence[tuple[str, str, str]], mixed: Collection[str] = ()) -> PropertyGraph:
        """What `write` left, for labels (with their keys; `mixed` ones have several) and relationships that exist there."""
        out = PropertyGraph()
        for label, key in nodes.items():
            if (df := table_at(spark, f"{path}/nodes/{label}")) is not None:
                out.nodes[label] = Nodes(df, key, mixed=label in mixed)
        for t, a, b in rels:
            if (df := table_at(spark, f"{path}/rels/{t}/{a}-{b}")) is not None:
                out.rels[t, a, b] = df
        return out


def _ends(rows: DataFrame, graph: PropertyGraph, m: RelationshipMapping, coerce: bool) -> list[tuple[Column, DataFrame] | None]:
    """For both endpoints: what a row is joined by and the keys to join, or None where nothing can match."""
    out: list[tuple[Column, DataFrame] | None] = []
    for end, label, key in ((SRC, m.from_label, m.from_key), (DST, m.to_label, m.to_key)):
        nodes = graph.nodes.get(label)
        if nodes is None:
            log.warning("relationship %s refers to label %s, which has no nodes", m.rel_type, label)
            out.append(None)
            continue
        known = nodes.keys if key == nodes.key else nodes.df
        x, k = F.col(end), column(known, key)
        kinds = type_of(rows, x), type_of(known, k)
        if _family(kinds[0]) is not _family(kinds[1]):
            if not coerce:
                log.warning("%s.%s is %s, but %s is %s: nothing matches", label, key, kinds[1].simpleString(), end, kinds[0].simpleString())
                out.append(None)
                continue
            x, k = pystr(x, kinds[0]), pystr(k, kinds[1])
        out.append((x, known.select(k.alias("__key"))))
    return out


def matched(rows: DataFrame, graph: PropertyGraph, m: RelationshipMapping, coerce: bool = False) -> DataFrame:
    """Rows whose endpoints exist, once for each pair of nodes that they name.

    A node key is unique after its merge; another property may not be, and then every
    node with the value matches. Endpoints of another type family never match unless
    `coerce` compares texts.
    """
    ends = _ends(rows, graph, m, coerce)
    if None in ends:
        return rows.where(F.lit(False))
    for x, keys in ends:
        rows = rows.join(keys, x == F.col("__key")).drop("__key")
    return rows


def merge_nodes(graph: PropertyGraph, label: str, key: str, projections: Sequence[DataFrame], mixed: bool = False) -> None:
    """Merge projections of one label, in order, into what the graph already holds.

    `mixed`: the label is merged by other keys too, so nodes may lack this one.
    """
    if mixed:
        graph.nodes[label] = _upserted(graph.nodes.get(label), key, projections)
        return
    rows = one_type([*([graph.nodes[label].df] if label in graph.nodes else []), *projections])
    found = reduce(lambda a, b: a.unionByName(b), [r.select(key) for r in rows])
    graph.nodes[label] = Nodes(merge(rows, [key]), key, found)


def _upserted(old: Nodes | None, key: str, projections: Sequence[DataFrame]) -> Nodes:
    """Every old node with a merged row's key value takes its properties; rows that match none are new nodes."""
    if old is None or key not in old.df.columns:
        new = merge(projections, [key])
        return Nodes(new if old is None else old.df.unionByName(new, allowMissingColumns=True), key if old is None else old.key, mixed=True)
    before, new = one_type([old.df, merge(projections, [key])])
    names = [c for c in new.columns if c != key]
    values = new.select(F.col(f"`{key}`").alias("__key"), F.struct(F.lit(True).alias("__hit"), *[F.col(f"`{c}`") for c in names]).alias("__new"))
    taken = {n: F.when(F.col("__new").isNotNull(), F.col("__new")[n]).otherwise(column(before, n)) for n in names}
    updated = before.join(values, F.col(f"`{key}`") == F.col("__key"), "left").withColumns(taken).drop("__key", "__new")
    fresh = new.join(before.select(F.col(f"`{key}`").alias("__key")), F.col(f"`{key}`") == F.col("__key"), "left_anti")
    return Nodes(updated.unionByName(fresh, allowMissingColumns=True), old.key, mixed=True)


def merge_rels(graph: PropertyGraph, m: RelationshipMapping, projections: Sequence[DataFrame], coerce: bool = False) -> None:
    at = (m.rel_type, m.from_label, m.to_label)
    old = [graph.rels[at]] if at in graph.rels else []
    graph.rels[at] = merge([*old, *[matched(with_sequence(p), graph, m, coerce) for p in projections]], [SRC, DST])


def dangling_rels(graph: PropertyGraph, m: RelationshipMapping, projection: DataFrame, coerce: bool = False) -> DataFrame:
    """Rows with an endpoint that does not exist; both ends are looked up in one pass."""
    rows, lost = projection, F.lit(False)
    for i, end in enumerate(_ends(projection, graph, m, coerce)):
        if end is None:
            return projection.drop(SEQ)
        x, keys = end
        found = keys.distinct().withColumn(f"__found{i}", F.lit(True))
        rows = rows.join(found, x == F.col("__key"), "left").drop("__key")
        lost = lost | F.col(f"__found{i}").isNull()
    return rows.where(lost).drop("__found0", "__found1", SEQ)
