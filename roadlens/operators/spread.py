"""How congestion spreads from a segment to its surroundings: calibration, prediction, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import conf
from ..conf import Settings
from ..functions import slots
from ..functions.columns import clip, ladder
from ..functions.quantiles import quantiles
from .detect import label_slots


def _source_means(span: DataFrame, rows: DataFrame) -> DataFrame:
    return (span.join(rows.select("segment_id", "ts", "drop"), ["segment_id", "ts"])
            .groupBy("incident_id", "segment_id").agg(F.avg("drop").alias("source_drop"), F.count("*").alias("n_slots")))


def calibration_samples(incidents: DataFrame, rows: DataFrame, reach: DataFrame, cfg: Settings) -> DataFrame:
    """Per incident and reached segment: drop relative to the source, and the slots until half of its own maximum."""
    span = label_slots(incidents, cfg, ("incident_id",))
    usable = _source_means(span, rows).filter((F.col("source_drop") > 0.1) & (F.col("n_slots") >= 2))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy("ts")) - 1
    pairs = (span.withColumn("place", place).join(usable.drop("segment_id"), "incident_id").join(reach, "segment_id"))
    seen = rows.select(F.col("segment_id").alias("reached_id"), "ts", "drop")
    per = (pairs.join(seen, ["reached_id", "ts"])
           .groupBy("incident_id", "reached_id", "hop", "direction", "source_drop")
           .agg(F.avg("drop").alias("mean_drop"), F.max("drop").alias("max_drop"),
                F.array_sort(F.collect_list(F.struct("place", "drop"))).alias("course")))
    # The course of one incident is bounded by its own duration.
    first = F.element_at(F.filter("course", lambda c: c["drop"] > 0.5 * F.col("max_drop")), 1)["place"]
    return (per.withColumn("ratio", F.col("mean_drop") / F.col("source_drop"))
            .withColumn("lag_min", F.when((F.col("hop") == 1) & (F.col("max_drop") > 0.05), first * cfg.step_minutes).cast("double"))
            .drop("course"))


def calibrate(samples: DataFrame, cfg: Settings) -> DataFrame:
    """(direction, hop, decay, lag_min_per_hop, samples): medians over the incidents."""
    decay = quantiles(samples, ["direction", "hop"], "ratio", {"decay": 0.5})
    lag = quantiles(samples, ["direction"], "lag_min", {"lag": 0.5})
    counts = samples.groupBy("direction", "hop").agg(F.count("*").alias("samples"))
    step = float(cfg.step_minutes)
    return (counts.join(decay, ["direction", "hop"], "left").join(lag, "direction", "left")
            .select("direction", "hop", "decay", F.greatest(F.coalesce("lag", F.lit(step)), F.lit(step)).alias("lag_min_per_hop"), "samples"))


def propagate(sources: DataFrame, load: DataFrame, reach: DataFrame, calibration: DataFrame, horizon_min: int | None = None,
              missing_load: float | None = 0.5) -> DataFrame:
    """Segments at risk from every source: ``sources`` (segment_id, ts, source_drop), ``load`` (segment_id, ts, flow_ratio)."""
    there = load.select(F.col("segment_id").alias("reached_id"), "ts", "flow_ratio")
    busy = F.col("flow_ratio") if missing_load is None else F.coalesce(F.col("flow_ratio"), F.lit(missing_load))
    factor = F.coalesce(clip(busy, 0, 1), F.lit(0.0)) * 0.5 + 0.75
    out = (sources.join(reach, "segment_id").join(calibration, ["direction", "hop"]).join(there, ["reached_id", "ts"], "left")
           .withColumn("predicted_drop", F.greatest(F.coalesce("source_drop", F.lit(0.0)), F.lit(0.0)) * F.col("decay") * factor)
           .withColumn("eta_min", F.col("lag_min_per_hop") * F.col("hop"))
           .withColumn("risk", F.least(F.lit(1.0), F.col("predicted_drop") / 0.4))
           .withColumn("impact_level", ladder("risk", conf.RISK_LEVELS, "MINIMAL")))
    if horizon_min is not None:
        out = out.filter(F.col("eta_min") <= horizon_min)
    return out.select("segment_id", "ts", "reached_id", "hop", "direction", "predicted_drop", "risk", "impact_level", "eta_min")


def high_risks(risks: DataFrame, keep: int = 4) -> DataFrame:
    """(segment_id, ts, at_risk): the segments a source may spill over to with a high risk, the largest risk first. Reach bounds their number."""
    each = F.struct((-F.round("risk", 9)).alias("order"), F.col("reached_id"))
    return (risks.filter("impact_level = 'HIGH'").groupBy("segment_id", "ts")
            .agg(F.transform(F.slice(F.array_sort(F.collect_set(each)), 1, keep), lambda x: x["reached_id"]).alias("at_risk")))


def evaluate(incidents: DataFrame, rows: DataFrame, reach: DataFrame, calibration: DataFrame, cfg: Settings,
             affected: float = 0.05, control_days=(-3, -2, -1, 1, 2, 3)) -> DataFrame:
    """One row: tp, fp, fn of the predicted neighbours and how often they drop that much on other days anyway."""
    issue = slots.shift(slots.ceil_slot("start_time", cfg), cfg.issue_delay_minutes)
    issued = incidents.withColumn("ts", issue).filter(F.col("ts").between(slots.at(cfg.val_start), slots.at(cfg.val_end)))
    after = (label_slots(incidents, cfg, ("incident_id",)).join(issued.select("incident_id", F.col("ts").alias("t_issue")), "incident_id")
             .filter(F.col("ts") > F.col("t_issue")))
    remaining = after.join(reach, "segment_id").select("incident_id", "reached_id", "hop", "direction", "ts")
    seen = rows.select(F.col("segment_id").alias("reached_id"), "ts", "drop")
    actual = (remaining.join(seen, ["reached_id", "ts"]).groupBy("incident_id", "reached_id")
              .agg(F.coalesce(F.avg("drop") > affected, F.lit(False)).alias("actual")))
    sources = issued.select("incident_id", "segment_id", "ts").join(
        rows.select("segment_id", "ts", F.col("drop").alias("source_drop")), ["segment_id", "ts"])
    predicted = (propagate(sources.select("segment_id", "ts", "source_drop").distinct(), rows, reach, calibration, missing_load=None)
                 .filter("impact_level <> 'MINIMAL'")
                 .join(sources.select("incident_id", "segment_id", "ts"), ["segment_id", "ts"])
                 .select("incident_id", "reached_id", F.lit(True).alias("predicted")))
    outcome = (actual.join(predicted, ["incident_id", "reached_id"], "left")
               .agg(F.count_if(F.col("predicted").isNotNull() & F.col("actual")).alias("tp"),
                    F.count_if(F.col("predicted").isNotNull() & ~F.col("actual")).alias("fp"),
                    F.count_if(F.col("predicted").isNull() & F.col("actual")).alias("fn")))
    # A control day counts only when the whole remaining window, moved there, lies inside the evaluated span.
    days = F.array(*[F.lit(d) for d in control_days])
    moved = remaining.withColumn("day", F.explode(days)).withColumn("there", F.col("ts") + F.make_dt_interval(F.col("day")))
    control = (moved.join(seen.withColumnRenamed("ts", "there"), ["reached_id", "there"], "left")
               .groupBy("incident_id", "reached_id", "day")
               .agg(F.avg("drop").alias("mean_drop"), F.min("there").alias("first"), F.max("there").alias("last"))
               .filter((F.col("first") >= slots.at(cfg.val_start)) & (F.col("last") <= slots.at(cfg.val_end)))
               .agg(F.count("*").alias("n"), F.count_if(F.col("mean_drop") > affected).alias("hits")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (outcome.withColumns({"control_n": control.select("n").scalar(), "control_hits": control.select("hits").scalar()})
            .withColumns({"hit_rate": F.when(tp + fp > 0, tp / (tp + fp)), "recall": F.when(tp + fn > 0, tp / (tp + fn)),
                          "control_rate": F.when(F.col("control_n") > 0, F.col("control_hits") / F.col("control_n"))}))
