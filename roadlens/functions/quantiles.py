"""Exact rank statistics of groups of any size, by selection in rounds.

Values are counted per distinct value. A coarse histogram (``COARSE`` steps per power of two, so its size follows the range of the values and not
the number of rows) tells which step holds each wanted rank; only those steps are looked at again, in ``FINE`` parts each, and only the parts
that hold a rank are ordered value by value. Each round finds ranks by merging them with the running counts in one window per
step, never by comparing every rank with every step. The counts and what a round finds are written: the next round reads the latter twice, and
without that one task would run, and hold the memory of, all rounds several times over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written
from .columns import col

COARSE, FINE = 16, 4096


def order_bucket(value) -> Column:
    """A long that never decreases as the value grows, with ``COARSE * FINE`` steps per power of two."""
    v = col(value)
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    position = octave + 1100 + size / F.pow(F.lit(2.0), octave) - 1
    return F.when(v == 0, F.lit(0)).otherwise(F.floor(F.signum(v) * position * (COARSE * FINE))).cast("long")


def coarse_bucket(fine) -> Column:
    """The coarse step of a fine one; as a floor it keeps the order of negative steps too."""
    return F.floor(col(fine) / FINE).cast("long")


def quantiles(df: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> probability). NULL values are left out."""
    keys = list(keys)
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    found = long_quantiles(df, keys, value, asked)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("quantile"))).alias(name) for name in probs])


def long_quantiles(df: DataFrame, keys, value: str, asked: Column) -> DataFrame:
    """(keys, name, quantile, n) for ``asked``, an array of (name, p); n is the group's row count. A group may hold any number of rows."""
    counted = df.select(*keys, F.col(value).alias("q_value")).filter(F.col("q_value").isNotNull()).groupBy(*keys, "q_value").agg(F.count("*").alias("q_copies"))
    return counted_quantiles(counted, keys, asked)


def counted_quantiles(counted: DataFrame, keys, asked: Column) -> DataFrame:
    """As :func:`long_quantiles`, from (keys, q_value, q_copies): distinct values and how often each occurs."""
    keys = list(keys)
    counted = written(_stepped(counted).select(*keys, "q_value", "q_copies", "q_fine", "q_coarse"), "rank-counts")
    spot = lambda x: x["p"] * (F.col("q_total") - 1)
    ranks = F.flatten(F.transform(asked, lambda x: F.array(*[
        F.struct(x["name"].alias("name"), spot(x).alias("q_spot"), r(spot(x)).cast("long").alias("q_rank")) for r in (F.floor, F.ceil)])))
    coarse = counted.groupBy(*keys, "q_coarse").agg(F.sum("q_copies").alias("q_copies"))
    wanted = coarse.groupBy(*keys).agg(F.sum("q_copies").alias("q_total")).withColumn("q_asked", F.explode(ranks)).select(*keys, "q_total", "q_asked.*")
    held = [*keys]
    for step, steps in (("q_coarse", coarse), ("q_fine", None), ("q_value", None)):
        if steps is None:
            steps = counted.join(wanted.select(*held).distinct(), held, "left_semi").groupBy(*held, step).agg(F.sum("q_copies").alias("q_copies"))
        wanted = written(_located(steps, wanted, held, step), "rank-places")
        held = [*held, step]
    low, high, at = F.min("q_value"), F.max("q_value"), F.first("q_spot")
    return wanted.groupBy(*keys, "name").agg((low + (at - F.floor(at)) * (high - low)).alias("quantile"), F.max("q_total").alias("n"))


def _stepped(counted: DataFrame) -> DataFrame:
    return counted.withColumn("q_fine", order_bucket("q_value")).withColumn("q_coarse", coarse_bucket("q_fine"))


def _located(steps: DataFrame, wanted: DataFrame, keys, step: str) -> DataFrame:
    """``wanted`` with the ``step`` that holds each rank; the rank then counts from that step's first row. ``steps``: (keys, step, q_copies)."""
    group = Window.partitionBy(*keys, F.lit(0))
    before = F.sum("q_copies").over(group.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)) - F.col("q_copies")
    marks = steps.select(*keys, before.alias("q_rank"), F.struct(F.col(step).alias("step"), before.alias("first")).alias("q_in"))
    # a step comes before the ranks that begin with it
    upto = group.orderBy("q_rank", F.col("q_in").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = wanted.unionByName(marks, allowMissingColumns=True).withColumn("q_at", F.last("q_in", ignorenulls=True).over(upto))
    return (both.filter(F.col("q_in").isNull()).withColumns({step: F.col("q_at.step"), "q_rank": F.col("q_rank") - F.col("q_at.first")})
            .drop("q_in", "q_at"))


def with_counts_below(counted: DataFrame, sums) -> DataFrame:
    """``counted`` (one row per distinct q_value) with ``<name>_below`` per column of ``sums``: its total over all smaller values.

    Running totals of the coarse steps, of the parts of each step and of the values of each part, added up: only the first, whose size does not
    follow the rows, is one group.
    """
    rows = _stepped(counted)
    held, levels = [], []
    for step in ("q_coarse", "q_fine", "q_value"):
        upto = Window.partitionBy(*held, F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        totals = rows.groupBy(*held, step).agg(*[F.sum(c).alias(c) for c in sums])
        levels.append((totals.select(*held, step, *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_{step}") for c in sums]), [*held, step]))
        held = [*held, step]
    rows = reduce(lambda df, level: df.join(level[0], level[1]), levels, rows)
    return rows.withColumns({f"{c}_below": sum((F.col(f"{c}_{step}") for step in held), F.lit(0)) for c in sums}).select(*counted.columns, *[f"{c}_below" for c in sums])
