"""From raw readings to a complete, quality-scored segment x slot grid.

The readings are collapsed per cell before anything else (partial aggregation, so a sensor that repeats itself millions of times
costs one row per task), and every later step works on the grid, where all segments have the same number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import VALUE_COLUMNS, Settings
from ..functions import slots
from ..functions.columns import no_nan, truth

MEASURES = (*VALUE_COLUMNS, "sensor_quality")
FLAGS = ("negative", "impossible", "spike", "stuck", "low_quality")


def over_time(cfg: Settings | None = None, first: int | None = None, last: int = 0):
    """The one window of the time-adjacent operators: a segment's slots in order."""
    w = Window.partitionBy("segment_id").orderBy("ts")
    return w if first is None else w.rowsBetween(first, last)


def known_rows(readings: DataFrame, segments: DataFrame) -> DataFrame:
    """Readings with a time and a known segment."""
    return readings.dropna(subset=["ts", "segment_id"]).join(segments.select("segment_id"), "segment_id", "left_semi")


def one_per_cell(readings: DataFrame, keep: str = "first") -> DataFrame:
    """The first (or last) arrival of every (segment, slot), with the number of arrivals; ``both`` has the last one's columns as ``last_*``.

    One ``min_by`` per column keeps fixed-width buffers, so this is a hash aggregate that combines before the shuffle.
    """
    first, last = (F.min_by, F.min), (F.max_by, F.max)
    ends = {"first": {"": first}, "last": {"": last}, "both": {"": first, "last_": last}}[keep]
    measures = [c for c in readings.columns if c not in ("segment_id", "ts", "ingest_seq")]
    kept = [c for name, (choose, edge) in ends.items()
            for c in (*[choose(m, "ingest_seq").alias(name + m) for m in measures], edge("ingest_seq").alias(f"{name}ingest_seq"))]
    return readings.dropna(subset=["ts", "segment_id"]).groupBy("segment_id", "ts").agg(*kept, F.count("*").alias("copies"))


def grid(segments: DataFrame, start: str, end: str, cfg: Settings, keep=("free_flow_speed_kmh", "capacity_vph")) -> DataFrame:
    """Every segment at every slot."""
    return segments.select("segment_id", *keep).withColumn("ts", F.explode(slots.slot_range(slots.at(start), slots.at(end), cfg)))


def cells(readings: DataFrame, segments: DataFrame, cfg: Settings, keep: str = "first") -> DataFrame:
    """The raw grid: one row per cell, measures NULL where nothing arrived. Unknown segments find no cell.

    What arrived grows with the cells, while the size of its compressed files may look small enough for a broadcast: the two are merged.
    """
    in_range = readings.filter(F.col("ts").between(slots.at(cfg.start), slots.at(cfg.end)))
    arrived = one_per_cell(no_nan(in_range, MEASURES), keep)
    return grid(segments, cfg.start, cfg.end, cfg).join(arrived.hint("merge"), ["segment_id", "ts"], "left")


def judged(raw: DataFrame) -> DataFrame:
    """The raw grid with one flag per kind of fault."""
    speed, flow, occupancy = F.col("speed_kmh"), F.col("flow_vph"), F.col("occupancy_pct")
    ff, cap = F.col("free_flow_speed_kmh"), F.col("capacity_vph")
    w = over_time()
    previous = F.lag("flow_vph").over(w)
    same = truth((speed == F.lag(speed).over(w)) & (flow == F.lag(flow).over(w)) & (occupancy == F.lag(occupancy).over(w)))
    below_zero = F.lit(False)
    for c in VALUE_COLUMNS:
        below_zero = below_zero | truth(F.col(c) < 0)
    return (raw
            .withColumns({
                "negative": below_zero,
                "impossible": truth(speed > 1.5 * ff) | truth(occupancy > 100) | truth(F.col("congestion_index") > 1),
                "spike": truth(flow > 2.5 * cap) | truth((flow > 3 * previous + 300) & (flow > cap)),
                "repeats": same,
                "low_quality": truth(F.col("sensor_quality") < 0.5),
            })
            # A fourth equal reading in a row: this one and the two before it all repeat their predecessor.
            .withColumn("stuck", F.col("repeats") & truth(F.lag("repeats", 1).over(w)) & truth(F.lag("repeats", 2).over(w))
                        & ~(truth(occupancy >= 97) | truth(flow <= 0)))
            .withColumn("rejected", F.col("negative") | F.col("impossible") | F.col("spike") | F.col("stuck") | F.col("low_quality"))
            .withColumn("valid", speed.isNotNull() & ~F.col("rejected")))


def filled(checked: DataFrame, cfg: Settings) -> DataFrame:
    """Rejected values removed, then carried forward for at most ``fill_slots`` slots; trailing quality added."""
    recent = over_time(cfg, -cfg.fill_slots)
    masked = checked.withColumns({c: F.when(~F.col("rejected"), F.col(c)) for c in VALUE_COLUMNS})
    return masked.withColumns({
        **{c: F.last(c, ignorenulls=True).over(recent) for c in VALUE_COLUMNS},
        "quality": F.avg(F.col("valid").cast("double")).over(over_time(cfg, 1 - cfg.quality_slots)),
    })


def sanitized(readings: DataFrame, segments: DataFrame, cfg: Settings) -> DataFrame:
    return (filled(judged(cells(readings, segments, cfg)), cfg)
            .select("segment_id", "ts", *VALUE_COLUMNS, "valid", "quality"))


def naive(readings: DataFrame, segments: DataFrame, cfg: Settings) -> DataFrame:
    """The grid without any cleaning, the last arrival winning."""
    raw = cells(readings, segments, cfg, keep="last")
    valid = F.col("speed_kmh").isNotNull()
    return (raw.withColumn("valid", valid)
            .withColumn("quality", F.avg(F.col("valid").cast("double")).over(over_time(cfg, 1 - cfg.quality_slots)))
            .select("segment_id", "ts", *VALUE_COLUMNS, "valid", "quality"))


def report(readings: DataFrame, segments: DataFrame, cfg: Settings) -> DataFrame:
    """One row of counters describing what the sanitiser saw and did; readings outside the configured span are counted as such."""
    checked = filled(judged(cells(readings, segments, cfg)).withColumn("raw_speed", F.col("speed_kmh")), cfg)
    counts = checked.agg(
        F.sum(F.coalesce(F.col("copies") - 1, F.lit(0))).alias("duplicates_removed"),
        F.count_if(F.col("raw_speed").isNull()).alias("missing_cells"),
        F.count_if("negative").alias("negative_cells"),
        F.count_if(F.col("impossible") & ~F.col("negative")).alias("impossible_cells"),
        F.count_if(F.col("spike") & ~F.col("negative") & ~F.col("impossible")).alias("spike_cells"),
        F.count_if("stuck").alias("stuck_cells"),
        F.count_if("rejected").alias("cells_rejected"),
        F.count_if(F.col("speed_kmh").isNull()).alias("cells_unfilled"),
        F.avg(F.col("valid").cast("double")).alias("quality_ratio"))
    inside = F.coalesce(F.col("ts").between(slots.at(cfg.start), slots.at(cfg.end)), F.lit(False))
    seen = readings.agg(F.count_if(inside).alias("rows_in"), F.count_if(~inside).alias("rows_outside"))
    return counts.withColumns({c: seen.select(c).scalar() for c in ("rows_in", "rows_outside")})


def as_of(panel: DataFrame, t: str, cfg: Settings) -> DataFrame:
    """The slots of the observation window that ends exactly at ``t``; nothing after it."""
    end = slots.floor_slot(slots.at(t), cfg)
    return slots.within(panel, slots.shift(end, -cfg.step_minutes * (cfg.history_slots - 1)), end, cfg)


def checked_time(df: DataFrame, column: str, cfg: Settings) -> DataFrame:
    """Requested times floored to the grid; times outside the observed span are dropped."""
    return (df.withColumn(column, slots.floor_slot(column, cfg))
            .filter(F.col(column).between(slots.at(cfg.start), slots.at(cfg.end))))


def fit_panel(panel: DataFrame, cfg: Settings) -> DataFrame:
    """The part of the panel anything may be fitted on."""
    return slots.within(panel, None, slots.at(cfg.val_end), cfg)


def write_panel(panel: DataFrame, path: str, cfg: Settings, n_segments: int, rows_per_file: int = 5_000_000) -> None:
    """Durable panel, partitioned by date. Each (date, segment group) goes to one task, so a date has as many files as it needs."""
    groups = max(1, -(-n_segments * cfg.slots_per_day // rows_per_file))
    (panel.withColumn("date", F.to_date("ts"))
          .withColumn("part", F.pmod(F.xxhash64("segment_id"), F.lit(groups)))
          .repartition("date", "part").drop("part").sortWithinPartitions("date", "segment_id", "ts")
          .write.mode("overwrite").partitionBy("date").option("compression", "zstd").parquet(path))


def read_panel(spark, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    panel = spark.read.parquet(path)
    if start is not None:
        panel = panel.filter((F.col("ts") >= slots.at(start)) & (F.col("date") >= slots.at(start).cast("date")))
    if end is not None:
        panel = panel.filter((F.col("ts") <= slots.at(end)) & (F.col("date") <= slots.at(end).cast("date")))
    return panel
