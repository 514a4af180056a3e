"""Parsers by name.

A parser turns a DataFrame with a text column into one with the canonical
columns and error_class, null where the line was read.  It is built from a dict
of options; options of a wrong type are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir import schema


class LineParser(Protocol):
    name: str

    def parse(self, df: DataFrame, value: str = "value") -> DataFrame: ...


Factory = Callable[[dict[str, Any]], LineParser]

_factories: dict[str, Factory] = {}


def register(name: str, factory: Factory) -> None:
    if not name:
        raise ValueError("a parser needs a name")
    if factory is None:
        raise ValueError(f"parser {name!r} needs a factory")
    if name in _factories:
        raise ValueError(f"parser {name!r} is registered already")
    _factories[name] = factory


def build(name: str, options: dict[str, Any] | None = None) -> LineParser:
    if name not in _factories:
        raise LookupError(f"unknown parser {name!r}; known: {', '.join(registered_names())}")
    return _factories[name](dict(options or {}))


def registered_names() -> list[str]:
    return sorted(_factories)


@contextmanager
def scratch() -> Iterator[None]:
    """Registrations made inside are undone; for tests."""
    kept = dict(_factories)
    try:
        yield
    finally:
        _factories.clear()
        _factories.update(kept)


def finish(df: DataFrame, source: str, error: Column, **columns: Column) -> DataFrame:
    """The canonical columns beside what df had; a line in error has only its class, source and raw text."""
    own = [c for c in df.columns if c not in {*schema.COLUMNS, "error_class"} and not c.startswith("_")]
    df = df.withColumn("_error", error)
    zero = {"ts": F.lit(None), "ts_ns": F.lit(0), "ts_offset_s": F.lit(0), "facility": F.lit(0), "host": F.lit(""), "proc": F.lit(""), "pid": F.lit(0), "fields": schema.no_fields()}
    given = zero | columns | {"src": F.lit(source)}
    given["level"] = schema.level_name(given["severity"])
    good = F.struct(*[given[f.name].cast(f.dataType).alias(f.name) for f in schema.RECORD], F.lit(None).cast("string").alias("error_class"))
    bad = F.struct(*[F.lit(source if f.name == "src" else None).cast(f.dataType).alias(f.name) for f in schema.RECORD], F.col("_error").alias("error_class"))
    # One branch a record, not one a column. A generator of one row: filters on the record are not pushed below it,
    # where they would repeat the whole parser inside each predicate.
    return df.select(*own, F.inline(F.array(F.when(F.col("_error").isNull(), good).otherwise(bad))))
