"""What is normal, what is not, since when and how sure: baselines, anomaly scores, states and events."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import conf
from ..conf import Settings
from ..functions import slots
from ..functions.columns import ratio_or_zero, state_of
from ..functions.quantiles import long_quantiles, quantiles
from ..sources.workspace import written
from .graph import neighbor_stat
from .panel import over_time


def with_daytype(df: DataFrame, context: DataFrame) -> DataFrame:
    """1 on weekends and holidays, else 0."""
    holidays = context.filter(F.col("holiday_flag") > 0).select("ts", F.lit(True).alias("is_holiday"))
    return (df.join(holidays, "ts", "left")
            .withColumn("daytype", ((F.weekday("ts") >= 5) | F.coalesce("is_holiday", F.lit(False))).cast("long")).drop("is_holiday"))


def label_slots(events: DataFrame, cfg: Settings, extra=()) -> DataFrame:
    """The slots of each labelled event: from its start, rounded up, to its end, both included."""
    span = slots.slot_range(slots.ceil_slot("start_time", cfg), slots.floor_slot("end_time", cfg), cfg)
    return (events.withColumn("ts", F.explode(span))
            .filter(F.col("ts").between(slots.at(cfg.start), slots.at(cfg.end))).select(*extra, "segment_id", "ts"))


def label_mask(events: DataFrame, cfg: Settings) -> DataFrame:
    return label_slots(events, cfg).distinct()


def active_roadworks(roadworks: DataFrame, cfg: Settings) -> DataFrame:
    """(segment_id, ts, works): roadworks in force at a slot; the end is not included."""
    last = slots.floor_slot(F.timestamp_micros(F.unix_micros("end_time") - 1), cfg)
    span = slots.slot_range(slots.ceil_slot("start_time", cfg), last, cfg)
    return (roadworks.withColumn("ts", F.explode(span)).filter(F.col("ts").between(slots.at(cfg.start), slots.at(cfg.end)))
            .groupBy("segment_id", "ts")
            .agg(F.count("*").alias("works"), F.min_by("work_type", F.struct("start_time", "work_id")).alias("work_type")))


# ---- baseline
def baseline(ratios: DataFrame, exclude: DataFrame) -> DataFrame:
    """Median and median absolute deviation of speed and flow ratio per segment, hour and day type, labelled slots left out.

    A group is one segment's slots of one hour, so the exact built-in median is bounded by the length of the history.
    """
    keys = ["segment_id", "hour", "daytype"]
    clean = (ratios.join(exclude.select("segment_id", "ts"), ["segment_id", "ts"], "left_anti")
             .select("segment_id", F.hour("ts").cast("long").alias("hour"), "daytype", "speed_ratio", "flow_ratio"))
    middle = clean.groupBy(*keys).agg(F.median("speed_ratio").alias("sr_med"), F.median("flow_ratio").alias("fr_med"))
    return (clean.join(middle, keys).groupBy(*keys)
            .agg(F.first("sr_med").alias("sr_med"), F.median(F.abs(F.col("speed_ratio") - F.col("sr_med"))).alias("sr_mad"),
                 F.first("fr_med").alias("fr_med"), F.median(F.abs(F.col("flow_ratio") - F.col("fr_med"))).alias("fr_mad")))


# ---- components and scores
def with_drops(ratios: DataFrame, base: DataFrame) -> DataFrame:
    return (ratios.withColumn("hour", F.hour("ts").cast("long")).join(base, ["segment_id", "hour", "daytype"], "left")
            .withColumn("drop", F.col("sr_med") - F.col("speed_ratio")))


def network_shift(drops: DataFrame) -> DataFrame:
    """The median drop of all segments per slot, never below zero."""
    middle = quantiles(drops, ["ts"], "drop", {"shift": 0.5})
    return middle.select("ts", F.greatest("shift", F.lit(0.0)).alias("net_shift"))


def components(ratios: DataFrame, base: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything the anomaly scores are made of, per cell."""
    drops = with_drops(ratios, base)
    rows = drops.join(network_shift(drops), "ts", "left")
    excess = F.col("drop") - F.col("net_shift")
    rows = rows.withColumns({
        "z_speed": excess / F.greatest(F.col("sr_mad") * conf.MAD_TO_SIGMA, F.lit(conf.SR_MAD_FLOOR)),
        "z_flow": (F.col("fr_med") - F.col("flow_ratio")) / F.greatest(F.col("fr_mad") * conf.MAD_TO_SIGMA, F.lit(conf.FLOW_MAD_FLOOR)),
        "local_drop": F.coalesce(excess, F.lit(0.0)),
    })
    around = neighbor_stat(rows.select("segment_id", "ts", "local_drop"), edges, [F.max("local_drop").alias("neighbor_max_drop")])
    return (rows.join(around, ["segment_id", "ts"], "left")
            .withColumn("neighbor_max_drop", F.coalesce("neighbor_max_drop", F.lit(0.0))))


def score(variant: str) -> Column:
    """One of the three score formulations, over the columns of :func:`components`."""
    local, beside = F.col("local_drop"), F.col("neighbor_max_drop")
    if variant == "z_composite":
        above = conf.Z_WEIGHTS["speed"] * F.when(F.col("z_speed").isNotNull(), F.greatest("z_speed", F.lit(0.0))) \
            + conf.Z_WEIGHTS["flow"] * F.when(F.col("z_flow").isNotNull(), F.greatest("z_flow", F.lit(0.0)))
        return F.coalesce(above, F.lit(0.0))
    if variant == "drop":
        return local
    return F.when(local >= beside, local).otherwise(F.lit(0.0))


def scored(parts: DataFrame, cfg: Settings) -> DataFrame:
    return (parts.withColumn("score", score(cfg.variant)).withColumn("anomalous", F.col("score") >= cfg.threshold)
            .withColumn("state", state_of("speed_ratio")))


def confidence(points: Column, threshold: float, quality: Column) -> Column:
    return (1 / (1 + F.exp(-(points - threshold) / (0.25 * threshold)))) * quality


def confidence_label(c) -> Column:
    return F.when(c >= 0.8, "HIGH").when(c >= 0.5, "MEDIUM").otherwise("LOW")


# ---- calibration
SWEEP_POINTS, SWEEP_FROM, SWEEP_TO = 300, 0.95, 0.99995
SWEEP_DIGITS = 9  # a threshold that is itself an observed score must count that score, whatever the last bit of the quantile


def threshold_sweep(parts: DataFrame, incidents: DataFrame, roadworks: DataFrame, variants=conf.VARIANTS) -> DataFrame:
    """(variant, threshold, tp, fp, fn, precision, recall, f1) for 300 high quantiles of every score, roadwork slots left out.

    Each cell is counted once, in the interval between two thresholds it falls into; what a threshold flags is the sum of the
    intervals above it. The thresholds themselves are a fitted artifact of at most 300 numbers per score.
    """
    keys = ["segment_id", "ts"]
    marked = (parts.join(roadworks.select(*keys), keys, "left_anti")
              .join(incidents.select(*keys, F.lit(1).alias("label")), keys, "left")
              .select(F.coalesce("label", F.lit(0)).alias("label"), *[F.round(score(v), SWEEP_DIGITS).alias(v) for v in variants]))
    marked = written(marked, "marked_scores")  # read for the thresholds and again for the counts
    asked = F.transform(F.sequence(F.lit(0), F.lit(SWEEP_POINTS - 1)), lambda i: F.struct(
        i.alias("name"), (i * (SWEEP_TO - SWEEP_FROM) / (SWEEP_POINTS - 1) + SWEEP_FROM).alias("p")))
    by_variant = marked.unpivot(["label"], list(variants), "variant", "value")
    found = long_quantiles(by_variant, ["variant"], "value", asked).select("variant", F.round("quantile", SWEEP_DIGITS).alias("quantile")).distinct().collect()
    cuts = {v: sorted(r.quantile for r in found if r.variant == v) for v in variants}
    placed = Bucketizer(splitsArray=[[float("-inf"), *cuts[v], float("inf")] for v in variants], inputCols=list(variants),
                        outputCols=[f"{v}_at" for v in variants]).transform(marked)
    places = F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"{v}_at").cast("int").alias("interval")) for v in variants]))
    counted = (placed.select("label", places).groupBy("variant", "interval")
               .agg(F.count("*").alias("cells"), F.sum("label").alias("hits")))
    levels = marked.sparkSession.createDataFrame(
        [(v, i, t) for v in variants for i, t in enumerate([None, *cuts[v]])], "variant string, interval int, threshold double")
    above = Window.partitionBy("variant").orderBy(F.col("interval").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    counts = (levels.join(counted, ["variant", "interval"], "left")
              .withColumns({"flagged": F.sum(F.coalesce("cells", zero)).over(above), "tp": F.sum(F.coalesce("hits", zero)).over(above),
                            "positives": F.sum(F.coalesce("hits", zero)).over(Window.partitionBy("variant"))})
              .filter(F.col("threshold").isNotNull())
              .select("variant", "threshold", "tp", (F.col("flagged") - F.col("tp")).alias("fp"),
                      (F.col("positives") - F.col("tp")).alias("fn")))
    return with_prf(counts)


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The threshold with the best F1 per variant (the lowest such threshold), the best variant marked."""
    order = Window.partitionBy("variant").orderBy(F.col("f1").desc(), "threshold")
    rank = F.array_position(F.array(*[F.lit(v) for v in conf.VARIANTS]), F.col("variant"))
    best = sweep.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
    return best.withColumn("chosen", F.row_number().over(Window.orderBy(F.col("f1").desc(), rank)) == 1)


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; an empty denominator gives zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (counts.withColumns({"precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn)})
            .withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


# ---- events
def with_runs(rows: DataFrame) -> DataFrame:
    """Adds to flagged rows the start of the run they belong to."""
    w = over_time()
    starts = F.col("anomalous") & ~F.coalesce(F.lag("anomalous").over(w), F.lit(False))
    return (rows.withColumns({"run_opens": starts, "prior_ratio": F.lag("speed_ratio").over(w)})
            .withColumn("run_start", F.when(F.col("anomalous"), F.last(F.when(F.col("run_opens"), F.col("ts")), ignorenulls=True)
                                            .over(over_time(None, Window.unboundedPreceding))))
            .withColumn("run_onset", F.when(F.col("anomalous"), F.last(
                F.when(F.col("run_opens"), F.struct((F.col("prior_ratio") - F.col("speed_ratio")).alias("step"))), ignorenulls=True)
                .over(over_time(None, Window.unboundedPreceding))).getField("step")))


def events(rows: DataFrame) -> DataFrame:
    """Contiguous flagged runs: (segment_id, start, end, slots, peak_score)."""
    return (with_runs(rows).filter("anomalous").groupBy("segment_id", F.col("run_start").alias("start"))
            .agg(F.max("ts").alias("end"), F.count("*").alias("slots"), F.max("score").alias("peak_score")))


def recent_events(rows: DataFrame, t: str, cfg: Settings) -> DataFrame:
    """Runs inside the last ``recent_slots`` slots up to ``t``; ongoing ones first, then by peak."""
    end = slots.at(t)
    window = slots.within(rows, slots.shift(end, -cfg.step_minutes * (cfg.recent_slots - 1)), end, cfg)
    return (events(window).withColumns({"ongoing": F.col("end") == end,
                                        "duration_min": F.col("slots") * cfg.step_minutes})
            .orderBy(F.col("ongoing").desc(), F.col("peak_score").desc(), "segment_id"))


def event_windows(windows: DataFrame, flagged: DataFrame, cfg: Settings) -> DataFrame:
    """Per evaluation window: does it hold a flagged slot, which segment peaked and how high.

    Windows are expanded to slots and met by an equi-join; flagged slots are reduced to the best one per slot first.
    """
    best = (flagged.filter("anomalous").groupBy("ts")
            .agg(F.max_by("segment_id", F.struct("score", "segment_id")).alias("segment_id"), F.max("score").alias("score"),
                 F.count("*").alias("flagged_cells")))
    span = slots.slot_range(slots.ceil_slot("window_start", cfg), slots.floor_slot("window_end", cfg), cfg)
    return (windows.withColumn("ts", F.explode(span)).join(best, "ts", "left")
            .groupBy("scenario_id", "window_start", "window_end")
            .agg(F.sum(F.coalesce("flagged_cells", F.lit(0))).alias("flagged_cells"),
                 F.max_by("segment_id", F.struct("score", "segment_id")).alias("peak_segment"), F.max("score").alias("peak_score"))
            .withColumn("has_event", F.col("flagged_cells") > 0))


# ---- recurring bottlenecks
def bottlenecks(ratios: DataFrame, exclude: DataFrame, cfg: Settings) -> DataFrame:
    """Segments whose throughput cannot rise at peak the way the rest of the network's does, repeatedly across days."""
    peak = F.hour("ts").isin(*cfg.peak_hours)
    clean = (ratios.join(exclude.select("segment_id", "ts"), ["segment_id", "ts"], "left_anti")
             .select("segment_id", F.to_date("ts").alias("day"), peak.alias("peak"), "flow_ratio", "congestion_index"))
    at_peak, off_peak = F.when(F.col("peak"), F.col("flow_ratio")), F.when(~F.col("peak"), F.col("flow_ratio"))
    whole = (clean.groupBy("segment_id")
             .agg(F.percentile(at_peak, F.lit(0.99)).alias("p"), F.percentile(off_peak, F.lit(0.99)).alias("o"),
                  F.avg(F.when(F.col("peak"), F.col("congestion_index"))).alias("peak_mean_congestion"))
             .withColumn("amplification", F.when(F.col("o") != 0, F.col("p") / F.col("o"))).drop("p", "o"))
    daily = (clean.groupBy("segment_id", "day")
             .agg(F.percentile(at_peak, F.lit(0.95)).alias("p"), F.percentile(off_peak, F.lit(0.95)).alias("o"))
             .select("segment_id", "day", F.when(F.col("o") != 0, F.col("p") / F.col("o")).alias("ratio")))
    # Both are one row per segment (and day): written, so that medians and spreads do not go back to the cells.
    whole, daily = written(whole, "amplification"), written(daily, "daily_amplification")
    overall = robust_z(whole, [], "amplification", "robust_z")
    low = (robust_z(daily, ["day"], "ratio", "z").groupBy("segment_id")
           .agg(F.count_if(F.col("z") <= conf.RECURRENCE_Z).alias("low_days")))
    days = ratios.select(F.to_date("ts").alias("day")).distinct().agg(F.count("*")).scalar()
    return (overall.join(low, "segment_id", "left")
            .select("segment_id", "amplification", "robust_z", (F.coalesce("low_days", F.lit(0)) / days).alias("recurrence"),
                    "peak_mean_congestion", F.coalesce(F.col("robust_z") <= conf.BOTTLENECK_Z, F.lit(False)).alias("detected")))


def robust_z(df: DataFrame, keys: list, value: str, name: str) -> DataFrame:
    """Distance from the group's median in scaled median absolute deviations."""
    def beside(left, right):
        if keys:
            return left.join(right, keys, "left")
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})

    centred = beside(df, quantiles(df, keys, value, {"g_med": 0.5})).withColumn("g_dev", F.abs(F.col(value) - F.col("g_med")))
    spread = quantiles(centred, keys, "g_dev", {"g_mad": 0.5})
    scaled = F.col("g_mad") * conf.MAD_TO_SIGMA
    return (beside(centred, spread).withColumn(name, F.when(scaled != 0, (F.col(value) - F.col("g_med")) / scaled))
            .drop("g_med", "g_dev", "g_mad"))
