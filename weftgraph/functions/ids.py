"""Deterministic ids of records from their untransformed fields."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.config import IdGenerationConfig
from weftgraph.functions.pyvalues import column, pystr, type_of

log = logging.getLogger(__name__)


def _text(df: DataFrame, field: str) -> Column:
    x = column(df, field)
    return pystr(x, type_of(df, x))


def generate_id(df: DataFrame, cfg: IdGenerationConfig) -> Column:
    """The id of a row; a missing or null field counts as '' (passthrough needs a value)."""
    missing = [f for f in cfg.fields if f not in df.columns]
    if cfg.fields and len(missing) == len(cfg.fields):
        raise ValueError(f"none of the id fields {cfg.fields} is in the source: all rows would share one id")
    if missing:
        log.warning("id fields %s are not in the source and count as empty", missing)
    if cfg.strategy == "passthrough":
        if not cfg.fields:
            raise ValueError("passthrough strategy requires a field")
        x = _text(df, cfg.fields[0])
        return F.concat(F.lit(cfg.prefix), F.coalesce(x, F.raise_error(F.lit(f"passthrough id field '{cfg.fields[0]}' is null")).cast("string")))
    joined = F.concat_ws(cfg.separator, *[F.coalesce(_text(df, f), F.lit("")) for f in cfg.fields])
    if cfg.strategy == "sha256-hash":
        joined = F.substring(F.sha2(joined, 256), 1, cfg.hash_length)
    return F.concat(F.lit(cfg.prefix), joined)
