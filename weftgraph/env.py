"""${NAME} and ${NAME:-default} in configuration values."""

from __future__ import annotations

import os
import re
from typing import Any

_NAME = re.compile(r"\$\{([^}:]+)(?::-([^}]*))?\}")


class MissingEnvironmentVariable(Exception):
    """A name without default is not set."""


def resolve(value: Any) -> Any:
    """`value` with every reference in its strings replaced; a variable set to '' counts as set."""
    if isinstance(value, dict):
        return {k: resolve(v) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        name, default = m.groups()
        found = os.environ.get(name, default)
        if found is None:
            raise MissingEnvironmentVariable(f"Environment variable '{name}' is not set and has no default")
        return found

    return _NAME.sub(put, value)
