"""HTTP APIs as a Python data source: pages are fetched on an executor, rows parsed by Spark.

Each page's stop rule needs the page before it, so the pages of one source are read in
order in one partition. They are read once into the shared folder while planning, and the
schema is inferred over all records: a field has the type that holds all its values. The
driver fetches the first page before, so that a wrong address or root fails at once.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from weftgraph.config import SourceConfig
from weftgraph.registry import source_registry
from weftgraph.resilience import retry
from weftgraph.sources.paths import removed_at_exit, shared_dir


class RateLimiter:
    """A token bucket; `acquire` sleeps until a token is there."""

    def __init__(self, requests_per_second: float, burst: int = 1) -> None:
        self.rate, self.burst = requests_per_second, max(1, burst)
        self._tokens, self._at = float(self.burst), time.monotonic()

    def acquire(self) -> None:
        now = time.monotonic()
        self._tokens = min(self.burst, self._tokens + (now - self._at) * self.rate)
        if self._tokens < 1:
            time.sleep((1 - self._tokens) / self.rate)
            self._tokens = 1.0
        self._at = time.monotonic()
        self._tokens -= 1


def at_root(data: Any, root: str | None) -> list:
    """The list at a dotted path; KeyError where a field is absent, ValueError where it is no list."""
    for part in root.split(".") if root else ():
        if isinstance(data, list):
            data = data[int(part)]
        elif isinstance(data, dict):
            data = data[part]
        else:
            raise KeyError(part)
    if not isinstance(data, list):
        raise ValueError(f"expected a list at '{root or ''}', got {type(data).__name__}")
    return data


def fetch(cfg: SourceConfig, extra: dict[str, Any]) -> Any:
    """One response as JSON; server errors are tried again."""
    query = urllib.parse.urlencode({**cfg.params, **extra}, doseq=True)
    url = cfg.url + ("&" if "?" in cfg.url else "?") * bool(query) + query
    body = None if cfg.body is None else json.dumps(cfg.body).encode()
    headers = ({"Content-Type": "application/json"} if body else {}) | cfg.headers
    request = urllib.request.Request(url, data=body, headers=headers, method=cfg.method)

    def get() -> Any:
        with urllib.request.urlopen(request, timeout=cfg.timeout) as response:
            return json.load(response)

    return retry(get, retryable_exceptions=(OSError,), base_delay=0.2)


def pages(cfg: SourceConfig) -> Iterator[list]:
    """Lists of records, in order; the first page must have its list, a later one without it ends the read."""
    limit = RateLimiter(cfg.rate_limit.requests_per_second, cfg.rate_limit.burst) if cfg.rate_limit else None
    p = cfg.pagination
    if p is None:
        if limit:
            limit.acquire()
        yield at_root(fetch(cfg, {}), cfg.json_root)
        return
    cursor: Any = None
    for nth in range(p.max_pages):
        if limit:
            limit.acquire()
        if p.type == "cursor":
            extra = {p.page_size_param: p.page_size} | ({p.cursor_field or "cursor": cursor} if cursor else {})
        else:
            extra = {p.page_param: nth + 1, p.page_size_param: p.page_size}
        data = fetch(cfg, extra)
        try:
            records = at_root(data, cfg.json_root)
        except (KeyError, ValueError):
            if nth == 0:
                raise
            return
        if records:
            yield records
        if p.type == "cursor":
            cursor = data
            for part in (p.next_cursor_path or "next_cursor").split("."):
                cursor = cursor.get(part) if isinstance(cursor, dict) else None
            if not cursor:
                return
        elif len(records) < p.page_size:
            return


class RestSource(DataSource):
    """format("weft_rest") with option `config`: a SourceConfig as JSON. One column of record texts."""

    @classmethod
    def name(cls) -> str:
        return "weft_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["config"])


class _Reader(DataSourceReader):
    def __init__(self, config: str) -> None:
        self.config = config

    def read(self, partition: Any) -> Iterator[tuple]:
        for page in pages(SourceConfig.model_validate_json(self.config)):
            for record in page:
                yield (json.dumps(record),)


@source_registry.register("rest")
def rest(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    spark.dataSource.register(RestSource)
    first = next(pages(cfg), [])
    raw = spark.read.format("weft_rest").option("config", cfg.model_dump_json()).load()
    if not first:
        return raw.limit(0)
    if not isinstance(first[0], dict):
        return raw
    path = removed_at_exit(spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}")
    raw.write.text(path)
    return spark.read.json(path, mode="FAILFAST", samplingRatio=1.0)
