"""Named tables of callables: sources and transforms, built in or added by a user."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Registry:
    """Name to callable; the last registration of a name counts."""

    def __init__(self, name: str) -> None:
        self.name, self._found = name, {}

    def register(self, key: str) -> Callable:
        def add(fn: Callable) -> Callable:
            if key in self:
                log.warning("registry %s: %r is replaced", self.name, key)
            self._found[key] = fn
            return fn

        return add

    def register_python(self, key: str, return_type: str) -> Callable:
        """Register a function of one Python value; it runs as an Arrow-batched UDF."""

        def add(fn: Callable) -> Callable:
            self.register(key)(lambda col, **params: F.udf(lambda v: fn(v, **params), return_type, useArrow=True)(col))
            return fn

        return add

    def get(self, key: str) -> Callable | None:
        return self._found.get(key)

    def __contains__(self, key: str) -> bool:
        return key in self._found

    def keys(self) -> list[str]:
        return [*self._found]


source_registry = Registry("source")
transform_registry = Registry("transform")
