"""Time-slot arithmetic on the regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import Settings
from .columns import col


def floor_slot(ts, cfg: Settings) -> Column:
    step = cfg.step_seconds
    return F.timestamp_seconds(F.floor(F.unix_seconds(col(ts)) / step) * step)


def ceil_slot(ts, cfg: Settings) -> Column:
    step = cfg.step_seconds * 1_000_000
    return F.timestamp_seconds(F.ceil(F.unix_micros(col(ts)) / step) * cfg.step_seconds)


def shift(ts, minutes: int) -> Column:
    return col(ts) + F.expr(f"INTERVAL {int(minutes)} MINUTES")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def slot_range(start, end, cfg: Settings) -> Column:
    """Array of the grid slots from ``start`` to ``end`` (both on the grid); empty when ``end`` is before ``start``."""
    start, end = col(start), col(end)
    return F.when(start <= end, F.sequence(start, end, F.expr(f"INTERVAL {cfg.step_minutes} MINUTES"))) \
            .otherwise(F.array().cast("array<timestamp>"))


PERIOD = "period"


def period(ts, cfg: Settings) -> Column:
    """First day of the part of the time axis that a table is partitioned by: days on a fine grid, weeks on a coarse one."""
    return F.to_date(F.date_trunc("day" if cfg.slots_per_day >= 24 else "week", col(ts)))


def within(df: DataFrame, start, end, cfg: Settings) -> DataFrame:
    """Rows from ``start`` to ``end`` (both included, either may be None). Of a table that is partitioned by period only those parts are read."""
    for bound, keeps in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            df = df.filter(keeps(F.col("ts"), bound))
            if PERIOD in df.columns:
                df = df.filter(keeps(F.col(PERIOD), period(bound, cfg)))
    return df.drop(PERIOD)


def minutes_between(later, earlier) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / 60e6
