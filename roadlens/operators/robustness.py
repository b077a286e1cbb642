"""Deterministic corruption of readings, and what the sanitiser is worth against it.

Whether and how a value is corrupted follows from a hash of its own key (MD5, which every engine has), so a job that is rerun after losing an
executor corrupts exactly the same rows. All kinds of noise are drawn in one pass over the readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import VALUE_COLUMNS, Settings
from ..functions import slots
from . import panel

KINDS = ("missing", "duplicates", "spikes", "stuck", "negatives", "shuffle", "combined")
RATE, STUCK_SHARE, STUCK_SLOTS, COPY = 0.05, 0.05, 24, 1 << 40


def digest(salt: str, key, digits: int, seed: int = 7) -> Column:
    """A whole number from the first hexadecimal ``digits`` of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}-{seed}-"), key.cast("string"))), 1, digits), 16, 10).cast("long")


def draw(salt: str, key, seed: int = 7) -> Column:
    """A reproducible number in [0, 1) per key."""
    return digest(salt, key, 8, seed) / float(1 << 32)


def stuck_block(cfg: Settings) -> Column:
    """Whether a reading lies in the block of slots in which its segment, one of a few, repeats its first reading."""
    first, last = F.unix_seconds(slots.at(cfg.start)), F.unix_seconds(slots.at(cfg.end))
    begin = first + F.floor(draw("stuck-at", F.col("segment_id")) * ((last - first) / cfg.step_seconds - STUCK_SLOTS)) * cfg.step_seconds
    return (draw("stuck", F.col("segment_id")) < STUCK_SHARE) & F.unix_seconds("ts").between(begin, begin + (STUCK_SLOTS - 1) * cfg.step_seconds)


def version(kind: str, seq: Column, rate: float) -> Column:
    """A reading as one kind of noise, or all of them, leaves it; NULL where it is lost. ``held_*`` are the values that a stuck sensor repeats."""
    on = lambda name: kind in (name, "combined")
    own, v = F.col("ingest_seq"), {c: F.col(c) for c in VALUE_COLUMNS}
    if on("missing"):
        v = {c: F.when(draw(f"null-{c}", own) >= rate / 2, x) for c, x in v.items()}
    if on("spikes"):
        v["flow_vph"] = F.when(draw("flow", seq) < rate / 5, v["flow_vph"] * (4 + 4 * draw("flow-size", seq)) + 2000).otherwise(v["flow_vph"])
        v["occupancy_pct"] = F.when(draw("occupancy", seq) < rate / 5, 120 + 180 * draw("occupancy-size", seq)).otherwise(v["occupancy_pct"])
    if on("stuck"):
        v = {c: F.when(F.col("in_block"), F.col(f"held_{c}")).otherwise(x) for c, x in v.items()}
    if on("negatives"):
        v |= {c: F.when(draw(f"negative-{c}", seq) < rate / 3, -F.abs(v[c])).otherwise(v[c]) for c in ("speed_kmh", "flow_vph", "occupancy_pct")}
    order = digest("shuffle", seq, 15) if on("shuffle") else seq
    row = F.struct(F.lit(kind).alias("scenario"), order.alias("ingest_seq"), *[x.alias(c) for c, x in v.items()])
    return F.when(draw("drop", own) >= rate, row) if on("missing") else row


def scenario_readings(readings: DataFrame, cfg: Settings, kinds=KINDS, rate: float = RATE) -> DataFrame:
    """The clean and every corrupted version of the readings, in one pass, told apart by ``scenario``."""
    rows = readings.withColumn("in_block", stuck_block(cfg))
    held = rows.filter("in_block").groupBy("segment_id").agg(*[F.min_by(c, F.struct("ts", "ingest_seq")).alias(f"held_{c}") for c in VALUE_COLUMNS])
    seq = F.col("ingest_seq")
    again = draw("again", seq) < rate
    entries = [F.struct(F.lit("clean").alias("scenario"), seq.alias("ingest_seq"), *VALUE_COLUMNS)]
    for kind in kinds:
        entries.append(version(kind, seq, rate))
        if kind in ("duplicates", "combined"):
            entries.append(F.when(again, version(kind, seq + F.lit(COPY), rate)))
    return rows.join(held, "segment_id", "left").select("segment_id", "ts", "sensor_quality", F.inline(F.array_compact(F.array(*entries))))


def prefixed(df: DataFrame, columns=("segment_id",)) -> DataFrame:
    by = [F.col(c) for c in ("pipeline", "scenario") if c in df.columns]
    return df.withColumns({c: F.concat_ws("|", *by, F.col(c)) for c in columns})


def scenario_panels(readings: DataFrame, segments: DataFrame, cfg: Settings, kinds=KINDS) -> DataFrame:
    """Sanitised and naive panels of every scenario; segment ids read pipeline|scenario|segment.

    Both pipelines look at one grid, which holds the first and the last arrival of each cell: noise is drawn, collapsed, laid on the grid and
    sorted by time once.
    """
    names = F.explode(F.array(*[F.lit(k) for k in ("clean", *kinds)]))
    rows = prefixed(scenario_readings(readings, cfg, kinds)).drop("scenario")
    segs = prefixed(segments.withColumn("scenario", names)).drop("scenario")
    checked = panel.filled(panel.judged(panel.cells(rows, segs, cfg, keep="both")), cfg)
    known = F.col("last_speed_kmh").isNotNull()
    checked = checked.withColumn("last_quality", F.avg(known.cast("double")).over(panel.over_time(cfg, 1 - cfg.quality_slots)))
    both = [F.struct(F.lit("sanitized").alias("pipeline"), *VALUE_COLUMNS, "valid", "quality"),
            F.struct(F.lit("naive").alias("pipeline"), *[F.col(f"last_{c}").alias(c) for c in VALUE_COLUMNS], known.alias("valid"), F.col("last_quality").alias("quality"))]
    return prefixed(checked.select("segment_id", "ts", F.inline(F.array(*both)))).drop("pipeline")


def per_scenario(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Splits the id again: adds pipeline and scenario, restores the segment id in ``base_id``."""
    parts = F.split("segment_id", r"\|")
    return df.withColumns({"pipeline": parts[0], "scenario": parts[1], "base_id": parts[2]})
