"""Where each runnable query, its oracle SQL and the inventory items it covers are recorded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    def keep(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, fn, sql, tuple(covers.split()))
        return fn

    return keep


def shaped(df: DataFrame, cols: list[str] | None = None, digits: int = 6, fine: tuple[str, ...] = ()) -> DataFrame:
    """Comparable output: dates as text, doubles rounded (``fine`` columns to 9 places, for ratios
    that can end exactly on a rounding edge), booleans as 0/1."""
    keep = df.select(*cols) if cols else df
    out = []
    for f in keep.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 9 if f.name in fine else digits)
        elif isinstance(f.dataType, (T.DateType,)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return keep.select(*out)
