"""Named queries: a Spark job over a city and, where it can be said in SQL, the statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .city import City, city
from .oracle_views import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
# Numbers are compared at six digits, rounded half up. The small excess over one half makes values that lie on the boundary up to
# floating-point noise (sums taken in another order) round alike in every engine.
SCALE, HALF = 1_000_000.0, 0.5001


def _columns(spec: str) -> list:
    return [tuple(item.split(":")) for item in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """The declared columns in order: s text, t timestamp, b boolean, i whole number, d number at six digits."""
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "d":
            c = F.floor(c.cast("double") * SCALE + HALF).cast("double") / SCALE
        elif kind == "i":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        name = f'"{name}"'
        if kind == "d":
            out.append(f"floor(CAST({name} AS DOUBLE) * 1e6::DOUBLE + {HALF}::DOUBLE) / 1e6::DOUBLE AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM ({body.strip()})"


def query(key: str, spec: str, sql: str | None = None, **local: str):
    """Register ``fn(city) -> DataFrame`` under ``key``; ``local`` holds extra SQL views of this query."""
    def register(fn: Callable[[City], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: shaped(fn(city(spark, sf_dir)), spec)
        if sql is not None:
            ORACLES[key] = oracle(shaped_sql(sql, spec), **local)
        return fn
    return register
