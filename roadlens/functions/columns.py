"""Small column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import conf


def decimals(c, digits: int = 2) -> Column:
    """A number as text with a fixed count of decimals, rounded half up but for floating-point noise, alike in every engine."""
    scale, v = 10 ** digits, col(c)
    n = F.floor(F.abs(v) * scale + 0.5001)
    return F.concat(F.when((v < 0) & (n > 0), "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truth(condition: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def clip(c, low=None, high=None) -> Column:
    """NULL-preserving clip (``least``/``greatest`` on their own skip NULLs)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)) if not isinstance(high, Column) else high)
    return F.when(c.isNotNull(), out)


def no_nan(df: DataFrame, columns) -> DataFrame:
    """Turn NaN into NULL once, at ingest."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def ladder(c, steps, otherwise) -> Column:
    """First step whose lower bound the value reaches; ``steps`` run from the highest bound down."""
    c = col(c)
    name, bound = steps[0]
    out = F.when(c >= bound, F.lit(name))
    for name, bound in steps[1:]:
        out = out.when(c >= bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def state_of(ratio) -> Column:
    return ladder(ratio, conf.STATES, "NO_DATA")


def lookup(c, mapping: dict, otherwise=None) -> Column:
    """A small fixed mapping as a CASE expression."""
    items = list(mapping.items())
    c = col(c)
    out = F.when(c == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def weighted_mean(weights: dict) -> Column:
    """Weighted mean of the columns that are present; the weights of missing ones are shared among the rest."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()])
    used = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()])
    return F.when(used > 0, total / used)


def dropped_components(weights: dict) -> Column:
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in weights])


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def half_even(c, digits: int = 0) -> Column:
    """Round half to even. Rounding to nine digits first keeps floating-point noise from deciding an exact half."""
    return F.bround(F.round(col(c), 9), digits)
