"""How good detection, forecasts and bottleneck flags are. The only place that reads labels as ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import conf
from ..conf import Settings
from ..functions import slots
from ..functions.columns import ratio_or_zero
from ..functions.quantiles import quantiles
from .corridor import ranking_quality
from .detect import events, label_slots, with_prf


def errors(y, yhat, prefix: str = "") -> list:
    """MAE, RMSE, count and MAPE over the rows that have both values."""
    e = F.col(yhat) - F.col(y)
    share = F.when(F.abs(y) > 1e-6, F.abs(e / F.col(y)))
    return [F.avg(F.abs(e)).alias(f"{prefix}mae"), F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"), F.count(e).alias(f"{prefix}n"),
            (F.avg(share) * 100).alias(f"{prefix}mape_pct")]


def forecast_metrics(forecast: DataFrame, actual: DataFrame, ratios: DataFrame, start: str, end: str) -> DataFrame:
    """Per metric and horizon: model against persistence, improvement, coverage of the band, and both on congested cells."""
    rows = (forecast.filter(F.col("ts").between(slots.at(start), slots.at(end)))
            .join(actual.drop("now"), ["segment_id", "ts", "metric", "horizon_min"]).join(ratios.select("segment_id", "ts", "speed_ratio"), ["segment_id", "ts"], "left"))
    busy = F.col("speed_ratio") < conf.STATES[0][1]
    rows = rows.withColumns({"y": F.col("actual"), "y_busy": F.when(busy, F.col("actual"))})
    within = F.when(F.col("y").isNotNull(), F.coalesce(F.col("y").between(F.col("p10"), F.col("p90")), F.lit(False)).cast("double"))
    return (rows.groupBy("metric", "horizon_min").agg(
        *errors("y", "p50", "model_"), *errors("y", "now", "persistence_"), *errors("y_busy", "p50", "busy_model_"), *errors("y_busy", "now", "busy_persistence_"),
        F.avg(within).alias("coverage"))
        .withColumn("improvement_pct", F.when(F.col("persistence_mae") != 0, (1 - F.col("model_mae") / F.col("persistence_mae")) * 100)))


def slot_level(rows: DataFrame, incidents: DataFrame, roadworks: DataFrame, start: str, end: str, cfg: Settings, keys=()) -> DataFrame:
    """Precision, recall and F1 of flagged slots against labelled ones, roadwork slots left out, with false positives per day."""
    cell = ["segment_id", "ts"]
    span = rows.filter(F.col("ts").between(slots.at(start), slots.at(end)))
    marked = span.join(roadworks, cell, "left_anti").join(incidents.withColumn("label", F.lit(True)), cell, "left").withColumn("label", F.coalesce("label", F.lit(False)))
    days = (slots.at(end).cast("long") - slots.at(start).cast("long") + cfg.step_seconds) / 86400
    hit, label = F.col("anomalous"), F.col("label")
    return with_prf(marked.groupBy(*keys).agg(F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"), F.count_if(~hit & label).alias("fn"))) \
        .withColumn("fp_per_day", F.col("fp") / days)


def incident_hits(incidents: DataFrame, rows: DataFrame, cfg: Settings) -> DataFrame:
    """Per incident: was it flagged within its window, when first, and how late."""
    span = label_slots(incidents, cfg, ("incident_id", "incident_type", "start_time"))
    return (span.join(rows.select("segment_id", "ts", "anomalous"), ["segment_id", "ts"])
            .groupBy("incident_id", "segment_id", "incident_type", "start_time").agg(F.min(F.when(F.col("anomalous"), F.col("ts"))).alias("first_hit"))
            .withColumn("delay_min", slots.minutes_between("first_hit", "start_time")))


def event_level(incidents: DataFrame, rows: DataFrame, labelled: DataFrame, start: str, end: str, cfg: Settings) -> DataFrame:
    """Incidents found, median delay, and detected events no label explains."""
    span = rows.filter(F.col("ts").between(slots.at(start), slots.at(end)))
    hits = incident_hits(incidents, span, cfg)
    found = hits.agg(F.count("first_hit").alias("detected")).withColumn(
        "median_delay_min", quantiles(hits, [], "delay_min", {"middle": 0.5}).scalar())
    total = incidents.agg(F.count("*")).scalar()
    runs = events(span)
    slots_of = runs.withColumn("ts", F.explode(slots.slot_range("start", "end", cfg)))
    explained = slots_of.join(labelled, ["segment_id", "ts"], "left_semi").select("segment_id", "start").distinct()
    loose = runs.join(explained, ["segment_id", "start"], "left_anti").agg(F.count("*"))
    days = (slots.at(end).cast("long") - slots.at(start).cast("long") + cfg.step_seconds) / 86400
    return (found.withColumns({"incidents": total, "events": runs.agg(F.count("*")).scalar(), "unmatched_events": loose.scalar()})
            .withColumns({"event_recall": F.when(F.col("incidents") > 0, F.col("detected") / F.col("incidents")), "unmatched_per_day": F.col("unmatched_events") / days}))


def type_accuracy(judged: DataFrame) -> DataFrame:
    """(incident_type, n, correct, unknown) and the overall row. ``judged``: (incident_type, likely_type), detected incidents only."""
    measures = [F.count("*").alias("n"), F.count_if(F.col("incident_type") == F.col("likely_type")).alias("correct"),
                F.count_if(F.col("likely_type") == "UNKNOWN").alias("unknown")]
    per = judged.groupBy("incident_type").agg(*measures)
    total = judged.agg(*measures).select(F.lit("all").alias("incident_type"), "n", "correct", "unknown")
    return per.unionByName(total).withColumns({"accuracy": ratio_or_zero(F.col("correct"), F.col("n")), "unknown_rate": ratio_or_zero(F.col("unknown"), F.col("n"))})


def absent_types(incidents: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("incident_type").distinct().join(incidents.select("incident_type"), "incident_type", "left_anti")


def bottleneck_quality(flags: DataFrame, segments: DataFrame, thresholds=(-1.5, -2.0, -2.5, -3.0)) -> DataFrame:
    """Precision, recall and F1 of the bottleneck flag at several thresholds."""
    rows = flags.join(segments.select("segment_id", (F.col("structural_bottleneck") == 1).alias("truth")), "segment_id").select("robust_z", "truth")
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    hit = F.coalesce(F.col("robust_z") <= F.col("threshold"), F.lit(False))
    return with_prf(rows.withColumn("threshold", F.explode(limits)).groupBy("threshold").agg(
        F.count_if(hit & F.col("truth")).alias("tp"), F.count_if(hit & ~F.col("truth")).alias("fp"), F.count_if(~hit & F.col("truth")).alias("fn"))) \
        .withColumn("flagged", F.col("tp") + F.col("fp"))


def bottleneck_ranking(flags: DataFrame, segments: DataFrame) -> DataFrame:
    """AUC of the ranking and how many of the top k are flagged in the benchmark."""
    rows = flags.join(segments.select("segment_id", (F.col("structural_bottleneck") == 1).alias("truth")), "segment_id")
    scored = rows.filter("robust_z IS NOT NULL").select(F.round(-F.col("robust_z"), 9).alias("v"), "truth")
    return ranking_quality(scored, "v", "truth")
