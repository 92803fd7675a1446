"""Jobs: configuration to lazy plans to a merged graph, with metrics.

Sources, validation, projection and merge are one plan for each label and relationship.
With an output, each label and relationship is written once and read back for what uses
it, and counts are observed in that write. Without one, the jobs that run are a count for
each mapping (with its rejects in the same pass), the check of a `fail` rule, and
constraints.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field
from itertools import groupby
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.config import IngestConfig, NodeMapping, RelationshipMapping, SchemaConstraint, SchemaDefinition, SchemaHook, SchemaIndex, ValidationConfig, load_config
from weftgraph.metrics import JobMetrics, StepMetric, TaskProgress
from weftgraph.operators import graph as g
from weftgraph.operators import hooks, schema
from weftgraph.operators.statements import node_statement, rel_statement, write_external
from weftgraph.operators.validation import Validated, apply_rules, validate
from weftgraph.resilience import RETRYABLE, healthy, retry
from weftgraph.sources import read_source
from weftgraph.sources.paths import file_system

log = logging.getLogger(__name__)


def counts(bad: Column) -> tuple[Column, Column]:
    """What is counted of rows of which some are bad."""
    return F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")


@dataclass
class IngestResult:
    """Rows taken by label and type (`nodes_created`), and the graph they merged into."""

    nodes_created: dict[str, int] = field(default_factory=dict)
    relationships_created: dict[str, int] = field(default_factory=dict)
    records_skipped: int = 0
    metrics: JobMetrics | None = None
    graph: g.PropertyGraph | None = None
    dead_letters: dict[str, DataFrame] = field(default_factory=dict)
    dangling: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def total_nodes(self) -> int:
        return sum(self.nodes_created.values())

    @property
    def total_relationships(self) -> int:
        return sum(self.relationships_created.values())

    @property
    def nodes_merged(self) -> dict[str, int]:
        """Distinct nodes by label; a job for each label."""
        return {k: n.df.count() for k, n in self.graph.nodes.items()} if self.graph else {}


def build_session(cfg: IngestConfig) -> SparkSession:
    s = cfg.settings.spark
    b = SparkSession.builder.appName(s.app_name)
    if s.master:
        b = b.master(s.master)
    for k, v in s.spark_config.items():
        b = b.config(k, v)
    return b.getOrCreate()


class Job:
    """One run of a configuration."""

    def __init__(self, cfg: IngestConfig, spark: SparkSession | None = None) -> None:
        self.cfg, self.spark = cfg, spark or build_session(cfg)
        self.metrics, self.result = JobMetrics(), IngestResult(graph=g.PropertyGraph())
        self.result.metrics = self.metrics
        self.sources: dict[str, DataFrame] = {}
        self.out = cfg.settings.output_path
        self.schema = cfg.graph_schema.model_copy(deep=True) if cfg.graph_schema else SchemaDefinition()
        self.staged: dict[object, DataFrame] = {}
        self.after_write: list[Callable[[], None]] = []
        self.rel_rows: list[tuple[str, RelationshipMapping, DataFrame]] = []
        self.persisted: list[DataFrame] = []
        keys = {(m.label, m.key) for m in cfg.nodes}
        #: Labels that mappings merge by several keys.
        self.mixed = {label for label, _ in keys if sum(x == label for x, _ in keys) > 1}

    def read(self, count: bool) -> None:
        """Plan every source; a dry run also counts it."""
        s = self.cfg.settings
        uses = [m.source for m in [*self.cfg.nodes, *self.cfg.relationships]]

        def one(cfg) -> DataFrame | None:
            try:
                with self.metrics.step(f"source:{cfg.name}") as step:
                    df = retry(read_source, self.spark, cfg, max_attempts=s.retry_max_attempts, base_delay=s.retry_base_delay, retryable_exceptions=RETRYABLE)
                    if s.continue_on_source_error:
                        df.limit(1).collect()  # errors that only a read shows
                    if count:
                        step.records_processed = df.count()
                    return df
            except Exception as e:
                self.metrics.errors.append(f"{cfg.name}: {e}")
                if not s.continue_on_source_error:
                    raise
                log.error("source %s failed: %s", cfg.name, e)
                return None

        workers = s.max_workers if s.parallel_sources else 1
        with ThreadPoolExecutor(workers) as pool:
            for cfg, df in zip(self.cfg.sources, pool.map(one, self.cfg.sources), strict=True):
                if df is None:
                    df = self.spark.createDataFrame([], T.StructType([]))
                elif s.spark.partitions:
                    df = df.repartition(s.spark.partitions)
                if uses.count(cfg.name) > 1 and not count and cfg.type in ("rest", "sql", "spark_jdbc"):
                    df = df.persist()  # files are read again more cheaply than they are kept
                    self.persisted.append(df)
                self.sources[cfg.name] = df

    def checked(self, name: str, source: str, rules: ValidationConfig | None) -> tuple[DataFrame, Validated | None]:
        df = self.sources[source]
        if not df.columns:
            return df, None
        v = validate(df, rules)
        if v is None:
            return df, None
        self.result.dead_letters[name] = v.rejects()
        return v.valid, v

    def count(self, step: StepMetric, df: DataFrame, v: Validated | None) -> None:
        """Rows taken and rejected, in one pass over what the rules need."""
        if v is None:
            step.records_processed = df.count() if df.columns else 0
            return
        row = v.df.agg(*counts(v.bad)).first()
        step.records_processed, step.records_failed = row.n - row.bad, row.bad
        self.result.records_skipped += row.bad

    def observed(self, step: StepMetric, df: DataFrame, v: Validated | None) -> tuple[DataFrame, Callable[[], None]]:
        """The valid rows, and what to call after the write that reads them to have their counts.

        Rows that the optimiser finds to join with nothing are never read, and so not
        observed; they are counted apart.
        """
        seen = Observation()
        plain, found = (df, counts(F.lit(False))) if v is None else (v.df, counts(v.bad))
        rows = plain.observe(seen, *found)

        def take() -> None:
            try:
                got = seen.get
                n, bad = got["n"], got["bad"]
            except (Py4JError, KeyError) as e:
                log.info("%s: not observed (%s), counted apart", step.name, type(e).__name__)
                n, bad = plain.agg(*found).first()
            step.records_processed, step.records_failed = n - bad, bad
            self.result.records_skipped += bad

        return rows if v is None else Validated(rows, v.failures).valid, take

    def taken(self, name: str, m: NodeMapping | RelationshipMapping, made: dict[str, int], kind: str) -> tuple[DataFrame, Callable[[], None]]:
        """The valid rows of a mapping. They are counted now, or with the write where there is an output."""
        with self.metrics.step(name) as step:
            df, v = self.checked(name, m.source, m.validation)
            made.setdefault(kind, 0)
            if self.out and df.columns:
                rows, take = self.observed(step, df, v)
            else:
                rows, take = df, lambda: self.count(step, df, v)
                take()
                made[kind] += step.records_processed
                return rows, lambda: None

        def later() -> None:
            take()
            step.stop()
            made[kind] += step.records_processed

        return rows, later

    def nodes(self) -> None:
        by_label: dict[str, list[NodeMapping]] = {}
        for m in self.cfg.nodes:
            by_label.setdefault(m.label, []).append(m)
        for label, mappings in by_label.items():
            rows, after = [], []  # (key, projection)
            for m in mappings:
                df, later = self.taken(f"nodes:{label}", m, self.result.nodes_created, label)
                after.append(later)
                if df.columns:
                    rows.append((m.key, g.project_nodes(df, m)))
                    self.send(rows[-1][1], node_statement(m, "event"))
            if not rows:
                continue
            if self.cfg.settings.strict_keys:
                for key, r in rows:
                    if not r.where(F.col(f"`{key}`").isNull()).isEmpty():
                        raise ValueError(f"null merge key '{key}' for label '{label}'")
            for key, same in groupby(rows, key=lambda x: x[0]):  # mappings in order; neighbours with one key are one merge
                g.merge_nodes(self.result.graph, label, key, [r for _, r in same], mixed=label in self.mixed)
            self.stage(label)
            for later in after:
                later()

    def stage(self, label: str) -> None:
        """Write merged nodes once, so that joins, constraints and hooks do not merge them again."""
        if self.out:
            graph = self.result.graph
            graph.write_nodes(label, f"{self.out}/staged", schema.layout(self.schema).get(label, ()))
            graph.nodes[label] = g.Nodes(self.spark.read.parquet(f"{self.out}/staged/nodes/{label}"), graph.nodes[label].key, mixed=graph.nodes[label].mixed)
            self.staged[label] = graph.nodes[label].df

    def rels(self) -> None:
        coerce = self.cfg.settings.coerce_endpoints
        by_type: dict[tuple, list[tuple[RelationshipMapping, DataFrame]]] = {}
        for m in self.cfg.relationships:
            name = f"rels:{m.rel_type}"
            df, later = self.taken(name, m, self.result.relationships_created, m.rel_type)
            self.after_write.append(later)
            if df.columns:
                rows = g.project_rels(df, m)
                self.send(rows, rel_statement(m, "event"))
                by_type.setdefault((m.rel_type, m.from_label, m.to_label), []).append((m, rows))
                plain = self.checked(name, m.source, m.validation)[0]
                self.rel_rows.append((name, m, g.project_rels(plain, m)))
        for at, found in by_type.items():
            keys = {(m.from_key, m.to_key) for m, _ in found}
            if len(keys) == 1:
                g.merge_rels(self.result.graph, found[0][0], [r for _, r in found], coerce)
            else:
                for m, r in found:
                    g.merge_rels(self.result.graph, m, [r], coerce)
            if self.out:
                graph = self.result.graph
                graph.write_rels(at, f"{self.out}/staged")
                graph.rels[at] = self.spark.read.parquet(f"{self.out}/staged/rels/{at[0]}/{at[1]}-{at[2]}")
                self.staged[at] = graph.rels[at]
        for later in self.after_write:
            later()

    def run_hooks(self, name: str, found: Iterable) -> None:
        found = list(found)
        if found:
            with self.metrics.step(name) as step:
                for h in found:
                    self.result.graph = hooks.run_hook(self.result.graph, h, self.spark)
                step.records_processed = len(found)

    def check(self) -> None:
        self.spark.sql("SELECT 1").collect()
        if self.out:
            fs, path = file_system(self.spark, self.out)
            if not fs.mkdirs(path):
                raise OSError(f"cannot write to {self.out}")

    def statements(self) -> list[SchemaHook]:
        """Pre-hooks other than schema statements, which join the schema: Spark checks them after the merge."""
        found = [(h, schema.parse_ddl(h.cypher)) for h in self.cfg.pre_hooks]
        self.schema.constraints += [d for _, d in found if isinstance(d, SchemaConstraint)]
        self.schema.indexes += [d for _, d in found if isinstance(d, SchemaIndex)]
        return [h for h, d in found if d is None]

    def send(self, projection: DataFrame, statement: str) -> None:
        """Hand a projection to the outside store, if a connector's format is set."""
        s = self.cfg.settings
        if s.external_format:
            retry(write_external, projection.drop(g.SEQ), statement, s.external_format, self.cfg.connection, s.spark.connector_batch_size, s.spark.partitions, max_attempts=s.retry_max_attempts, base_delay=s.retry_base_delay, retryable_exceptions=RETRYABLE)

    def dry(self) -> None:
        for m in [*self.cfg.nodes, *self.cfg.relationships]:
            if m.validation and m.validation.rules:
                with self.metrics.step(f"validate:{m.source}") as step:
                    df = self.sources[m.source]
                    if df.columns:
                        self.count(step, df, apply_rules(df, m.validation.rules))
        self.result.records_skipped = 0

    def run(self, dry_run: bool, pre: Iterable[Callable], post: Iterable[Callable]) -> IngestResult:
        cfg, s, out = self.cfg, self.cfg.settings, self.out
        if s.health_check and not healthy(self.check):
            raise ConnectionError("the Spark session does not answer, or its output cannot be written")
        self.read(count=dry_run)
        if dry_run:
            self.dry()
            return self.result
        if out:
            known = {m.label: m.key for m in reversed(cfg.nodes)}  # the first mapping names a label's key
            self.result.graph = g.PropertyGraph.read(self.spark, f"{out}/current", known, [(m.rel_type, m.from_label, m.to_label) for m in cfg.relationships], self.mixed)
        rest = self.statements()
        if stated := self.schema.to_hooks():
            with self.metrics.step("schema") as step:
                step.records_processed = len(stated)
        self.run_hooks("pre_hooks", [*rest, *pre])
        self.nodes()
        if self.schema.constraints:
            with self.metrics.step("constraints"):
                schema.enforce(self.result.graph, self.schema)
        self.rels()
        self.run_hooks("post_hooks", [*cfg.post_hooks, *post])
        if out:
            with self.metrics.step("write"):
                self.write(out)
        for name, m, rows in self.rel_rows:  # over the tables that stay
            self.result.dangling[name] = g.dangling_rels(self.result.graph, m, rows, s.coerce_endpoints)
        return self.result

    def write(self, out: str) -> None:
        """Complete the tables beside the current ones, then swap: a lost job leaves `current`, or else `previous`."""
        graph, new, old = self.result.graph, f"{out}/next", f"{out}/current"
        fs, _ = file_system(self.spark, out)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(path(new), True)
        order = schema.layout(self.schema)

        def move(part: str) -> None:
            fs.mkdirs(path(f"{new}/{part}").getParent())
            fs.rename(path(f"{out}/staged/{part}"), path(f"{new}/{part}"))

        changed = [label for label, n in graph.nodes.items() if n.df is not self.staged.get(label)]
        for label in changed:  # these read staged tables, so they go first
            graph.write_nodes(label, new, order.get(label, ()))
        for at, df in graph.rels.items():
            if df is not self.staged.get(at):
                graph.write_rels(at, new)
        for label in graph.nodes.keys() - changed:
            move(f"nodes/{label}")
        for at, df in graph.rels.items():
            if df is self.staged.get(at):
                move(f"rels/{at[0]}/{at[1]}-{at[2]}")
        if fs.exists(path(old)):
            fs.delete(path(f"{out}/previous"), True)
            fs.rename(path(old), path(f"{out}/previous"))
        fs.rename(path(new), path(old))
        fs.delete(path(f"{out}/staged"), True)
        self.result.graph = g.PropertyGraph.read(self.spark, old, {k: n.key for k, n in graph.nodes.items()}, list(graph.rels), self.mixed)


def run(cfg: IngestConfig, dry_run: bool = False, spark: SparkSession | None = None, pre_hooks: Iterable[Callable] = (), post_hooks: Iterable[Callable] = (), config_path: str = "") -> IngestResult:
    """Run a job. Metrics are complete, and written where asked, even when it fails."""
    job = Job(cfg, spark)
    m, seconds = job.metrics, cfg.settings.progress_seconds
    m.config_path = config_path
    try:
        with m, TaskProgress(job.spark, seconds) if seconds else nullcontext():
            return job.run(dry_run, pre_hooks, post_hooks)
    finally:
        m.log_summary()
        if cfg.settings.metrics_output:
            Path(cfg.settings.metrics_output).write_text(m.to_json(), encoding="utf-8")
        for df in job.persisted if m.status == "failed" else ():
            df.unpersist()


def run_from_file(path: str | Path, dry_run: bool = False, spark: SparkSession | None = None) -> IngestResult:
    return run(load_config(path), dry_run, spark, config_path=str(path))


def validate_config(path: str | Path) -> IngestConfig:
    return load_config(path)
