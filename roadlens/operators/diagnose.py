"""Causes, evidence, incident-type likelihood and the snapshot rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import conf
from ..conf import Settings
from ..functions import slots
from .detect import confidence, confidence_label, label_slots, with_runs
from .panel import over_time


def snapshots(rows: DataFrame, segments: DataFrame, recurring: DataFrame, cfg: Settings) -> DataFrame:
    """The snapshot row of every segment at every slot. ``rows`` are scored components."""
    static = segments.select("segment_id", "length_km", "road_class", F.col("signal_id").isNotNull().alias("signalized"))
    known = recurring.filter("detected").select("segment_id", F.lit(True).alias("is_recurring"))
    free = F.col("length_km") / F.col("free_flow_speed_kmh") * 60
    return (rows.join(static, "segment_id").join(known, "segment_id", "left")
            .select("segment_id", "ts", "state", "speed_kmh", "flow_vph", "occupancy_pct",
                    F.when(F.col("speed_ratio") > 0, free / F.col("speed_ratio")).alias("travel_time_min"),
                    free.alias("free_flow_time_min"), "delay_min", F.col("queue_length_veh").alias("queue_veh"), "congestion_index",
                    F.col("flow_ratio").alias("capacity_utilization"), "speed_ratio", F.col("score").alias("anomaly_score"),
                    "anomalous", confidence(F.col("score"), cfg.threshold, F.col("quality")).alias("confidence"),
                    F.col("quality").alias("data_quality"), "road_class", "signalized",
                    F.coalesce("is_recurring", F.lit(False)).alias("recurring_bottleneck_detected")))


def snapshot_summary(snaps: DataFrame) -> DataFrame:
    """Per slot: how many segments are in each state, anomalous ones, quality and speed."""
    states = [name for name, _ in conf.STATES] + ["NO_DATA"]
    return snaps.groupBy("ts").agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in states], F.count_if("anomalous").alias("n_anomalous"),
        F.avg("data_quality").alias("mean_quality"), F.avg("speed_ratio").alias("mean_speed_ratio"))


def spill_sources(rows: DataFrame, edges: DataFrame, cfg: Settings) -> DataFrame:
    """For the cells that look like spill-back, the neighbour with the largest drop (the last id on a tie)."""
    own = rows.filter((F.col("local_drop") >= cfg.threshold) & (F.col("neighbor_max_drop") > F.col("local_drop"))) \
        .select("segment_id", "ts", "neighbor_max_drop")
    beside = rows.select(F.col("segment_id").alias("neighbor_id"), "ts", F.col("local_drop").alias("its_drop"))
    return (own.join(edges.select("segment_id", "neighbor_id").distinct(), "segment_id").join(beside, ["neighbor_id", "ts"])
            .filter(F.col("its_drop") == F.col("neighbor_max_drop"))
            .groupBy("segment_id", "ts").agg(F.max("neighbor_id").alias("worst_neighbor")))


def diagnoses(rows: DataFrame, roadworks_active: DataFrame, recurring: DataFrame, context: DataFrame, edges: DataFrame,
              cfg: Settings) -> DataFrame:
    """Rule-based cause of every cell, first match wins, with the figures it rests on."""
    known = recurring.filter("detected").select("segment_id", F.lit(True).alias("is_recurring"))
    day = context.select("ts", "rain_intensity", (F.coalesce("event_level", F.lit(0)) > 0).alias("event_present"))
    full = (with_runs(rows).join(roadworks_active, ["segment_id", "ts"], "left").join(known, "segment_id", "left")
            .join(day, "ts", "left").join(spill_sources(rows, edges, cfg), ["segment_id", "ts"], "left"))
    thr = cfg.threshold
    working = F.col("works").isNotNull()
    congested = F.coalesce(F.col("speed_ratio") < conf.STATES[0][1], F.lit(False))
    onset = F.when(F.col("anomalous"), F.coalesce("run_onset", F.lit(0.0))).otherwise(0.0)
    spread = (F.col("local_drop") >= thr) & (F.col("neighbor_max_drop") > F.col("local_drop"))
    outside = ((F.col("net_shift") >= conf.NETWORK_SHIFT_EFFECT) | (F.col("rain_intensity") >= conf.RAIN_EFFECT)
               | F.col("event_present"))
    cause = (F.when(working, "ROADWORK_EFFECT")
             .when(F.col("anomalous") & (onset >= 0.1), "TRANSIENT_INCIDENT")
             .when(F.col("anomalous"), "UNKNOWN")
             .when(spread, "PROPAGATED_CONGESTION")
             .when(congested & F.coalesce("is_recurring", F.lit(False)) & F.hour("ts").isin(*cfg.peak_hours), "RECURRING_BOTTLENECK")
             .when(congested & F.coalesce(outside, F.lit(False)), "WEATHER_EVENT_EFFECT")
             .otherwise("NORMAL_VARIATION"))
    minutes = F.when(F.col("anomalous"), (F.unix_seconds("ts") - F.unix_seconds("run_start")) / 60 + cfg.step_minutes).otherwise(0.0)
    out = full.withColumns({
        "cause": cause, "onset_step": onset, "duration_min": minutes.cast("long"), "roadwork_active": working,
        "is_congested": congested, "recurring": F.coalesce("is_recurring", F.lit(False)),
        "source_neighbor": F.when(cause == "PROPAGATED_CONGESTION", F.col("worst_neighbor")),
        "confidence": confidence(F.col("score"), thr, F.col("quality"))})
    return out.withColumns({"confidence_label": confidence_label(F.col("confidence")), "reason": reason()})


def reason():
    c = F.col("cause")
    return (F.when(c == "ROADWORK_EFFECT", F.format_string("%d active roadwork(s), %s", F.col("works"), F.col("work_type")))
            .when(c == "TRANSIENT_INCIDENT", F.format_string("speed ratio fell %.2f in one step", F.col("onset_step")))
            .when(c == "UNKNOWN", F.lit("anomalous, but the onset was gradual"))
            .when(c == "PROPAGATED_CONGESTION", F.format_string("neighbor %s dropped %.2f, this segment %.2f", F.col("worst_neighbor"),
                                                                 F.col("neighbor_max_drop"), F.col("local_drop")))
            .when(c == "RECURRING_BOTTLENECK", F.lit("known peak-hour throughput ceiling"))
            .when(c == "WEATHER_EVENT_EFFECT", F.format_string("network-wide shift %.3f, rain %.2f", F.col("net_shift"),
                                                                F.col("rain_intensity")))
            .otherwise("within the normal range for this hour and day type"))


def detections(diagnosed: DataFrame) -> DataFrame:
    """Anomalous or non-normal cells with their cause, best score first."""
    return (diagnosed.filter(F.col("anomalous") | (F.col("state") != "NORMAL"))
            .select("segment_id", "ts", "state", "score", "cause", "confidence", "confidence_label")
            .orderBy(F.col("score").desc(), "segment_id", "ts"))


# The evidence list, in order. metric, unit, source.
EVIDENCE = (("speed", "km/h", "traffic"), ("local_speed_ratio_drop", "", "traffic"), ("flow", "veh/h", "traffic"),
            ("congestion_index", "", "traffic"), ("queue_change_15min", "veh", "traffic"), ("largest_neighbor_drop", "", "traffic"),
            ("network_wide_shift", "", "traffic (all segments)"), ("rain_intensity", "", "context"), ("event_present", "", "context"),
            ("roadwork_active", "", "roadworks (start <= t < end)"), ("data_quality", "", "sanitizer"))


def evidence(diagnosed: DataFrame, cfg: Settings) -> DataFrame:
    """Long table (segment_id, ts, metric, value, baseline, diff_pct, threshold, unit, source), eleven rows per cell."""
    queue = F.col("queue_length_veh") - F.lag("queue_length_veh", cfg.slope).over(over_time())
    rows = diagnosed.withColumn("queue_change", queue)
    values = {"speed": F.col("speed_kmh"), "local_speed_ratio_drop": F.col("local_drop"), "flow": F.col("flow_vph"),
              "congestion_index": F.col("congestion_index"), "queue_change_15min": F.col("queue_change"),
              "largest_neighbor_drop": F.col("neighbor_max_drop"), "network_wide_shift": F.col("net_shift"),
              "rain_intensity": F.col("rain_intensity"), "event_present": F.col("event_present").cast("double"),
              "roadwork_active": F.col("roadwork_active").cast("double"), "data_quality": F.col("quality")}
    baselines = {"speed": F.col("sr_med") * F.col("free_flow_speed_kmh"), "flow": F.col("fr_med") * F.col("capacity_vph"),
                 "congestion_index": 1 - F.col("sr_med")}
    limits = {"local_speed_ratio_drop": cfg.threshold, "network_wide_shift": conf.NETWORK_SHIFT_EFFECT,
              "rain_intensity": conf.RAIN_EFFECT}
    items = F.array(*[F.struct(
        F.lit(m).alias("metric"), values[m].cast("double").alias("value"),
        baselines.get(m, F.lit(None)).cast("double").alias("baseline"), F.lit(limits.get(m)).cast("double").alias("threshold"),
        F.lit(unit).alias("unit"), F.lit(source).alias("source")) for m, unit, source in EVIDENCE])
    change = F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.abs("baseline") * 100)
    return (rows.select("segment_id", "ts", F.inline(items))
            .withColumn("diff_pct", change))


def segment_details(segments: DataFrame, snaps: DataFrame, diagnosed: DataFrame, items: DataFrame) -> DataFrame:
    """One nested record per cell: static attributes, state, cause and the evidence list."""
    listed = items.groupBy("segment_id", "ts").agg(
        F.sort_array(F.collect_list(F.struct("metric", "value", "baseline", "diff_pct", "threshold", "unit", "source"))).alias("evidence"))
    return (snaps.drop("road_class").join(diagnosed.select("segment_id", "ts", "cause", "reason", "onset_step", "duration_min"),
                                          ["segment_id", "ts"])
            .join(listed, ["segment_id", "ts"]).join(listing(segments), "segment_id"))


def listing(segments: DataFrame) -> DataFrame:
    """Static attributes without the two benchmark labels."""
    return segments.drop("structural_bottleneck", "peak_capacity_factor", "idx")


# ---- incident types
def incident_shapes(incidents: DataFrame, rows: DataFrame, cfg: Settings) -> DataFrame:
    """Mean speed-ratio drop and relative flow change over each incident's slots."""
    span = label_slots(incidents, cfg, ("incident_id", "incident_type"))
    change = F.col("flow_ratio") / F.when(F.col("fr_med").isNotNull(), F.greatest("fr_med", F.lit(1e-3))) - 1
    return (span.join(rows.select("segment_id", "ts", "drop", change.alias("flow_change")), ["segment_id", "ts"])
            .groupBy("incident_id", "segment_id", "incident_type")
            .agg(F.avg("drop").alias("mean_drop"), F.avg("flow_change").alias("mean_flow_change"))
            .filter(F.col("mean_drop").isNotNull() & F.col("mean_flow_change").isNotNull()))


def centroids(shapes: DataFrame) -> DataFrame:
    """Mean shape per incident type with the pooled spread over all incidents."""
    pooled = shapes.agg(F.greatest(F.stddev_pop("mean_drop"), F.lit(1e-3)).alias("sd_drop"),
                        F.greatest(F.stddev_pop("mean_flow_change"), F.lit(1e-3)).alias("sd_flow"))
    return (shapes.groupBy("incident_type").agg(F.avg("mean_drop").alias("c_drop"), F.avg("mean_flow_change").alias("c_flow"),
                                                F.count("*").alias("incidents"))
            .withColumns({"sd_drop": pooled.select("sd_drop").scalar(), "sd_flow": pooled.select("sd_flow").scalar()}))


def type_likelihood(shapes: DataFrame, centres: DataFrame) -> DataFrame:
    """Most likely type per shape (id column ``incident_id``), UNKNOWN when no type is clearly ahead.

    The centres are one row per incident type: they travel as one array beside every shape.
    """
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("incident_type", "c_drop", "c_flow", "sd_drop", "sd_flow"))))
    pull = lambda c: F.exp(-0.5 * (F.pow((F.col("mean_drop") - c["c_drop"]) / c["sd_drop"], 2)
                                   + F.pow((F.col("mean_flow_change") - c["c_flow"]) / c["sd_flow"], 2)))
    weights = F.transform(F.col("centres"), lambda c: F.struct(pull(c).alias("w"), c["incident_type"].alias("t")))
    total = F.aggregate(F.col("weights"), F.lit(0.0), lambda a, w: a + w["w"])
    best = F.array_max(F.col("weights"))
    return (shapes.withColumn("centres", packed.scalar()).withColumn("weights", weights)
            .withColumn("likelihood", F.when(total > 0, best["w"] / total).otherwise(F.lit(0.0)))
            .withColumn("likely_type", F.when(F.col("likelihood") < conf.TYPE_MIN_LIKELIHOOD, "UNKNOWN").otherwise(best["t"]))
            .withColumn("type_confidence", F.when((F.col("likelihood") >= 0.7), "MEDIUM").otherwise("LOW"))
            .drop("centres", "weights"))


def run_shapes(rows: DataFrame) -> DataFrame:
    """The shape of every flagged run so far, per flagged cell: what the type likelihood at that slot is based on."""
    w = Window.partitionBy("segment_id", "run_start").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("flow_ratio") / F.when(F.col("fr_med").isNotNull(), F.greatest("fr_med", F.lit(1e-3))) - 1
    return (with_runs(rows).filter("anomalous").withColumn("flow_change", change)
            .select("segment_id", "ts", "run_start", F.avg("drop").over(w).alias("mean_drop"),
                    F.avg("flow_change").over(w).alias("mean_flow_change"))
            .filter(F.col("mean_drop").isNotNull() & F.col("mean_flow_change").isNotNull()))


# ---- scenarios
def scenarios(incidents: DataFrame, candidates: DataFrame, diagnosed: DataFrame, cfg: Settings) -> DataFrame:
    """Each incident at its demonstration time: state and cause there, and whether a candidate targets the segment directly."""
    direct = candidates.select(F.col("target_segment").alias("segment_id"), F.lit(True).alias("has_direct")).distinct()
    shown = incidents.withColumn("demo_time", slots.shift(slots.ceil_slot("start_time", cfg), cfg.issue_delay_minutes))
    return (shown.join(direct, "segment_id", "left")
            .join(diagnosed.select("segment_id", F.col("ts").alias("demo_time"), "state", "cause", "score"),
                  ["segment_id", "demo_time"], "left")
            .select("incident_id", "segment_id", "demo_time", F.coalesce("has_direct", F.lit(False)).alias("direct_candidate"),
                    "state", "cause", "score"))
