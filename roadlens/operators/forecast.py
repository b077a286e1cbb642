"""Short-term forecasts: boosted trees per metric and horizon, empirical bands, and what follows from a forecast table.

A forecast table is long: (segment_id, ts, metric, horizon_min, now, p50, p10, p90).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import conf
from ..conf import FORECAST_METRICS, Settings
from ..functions import slots
from ..functions.columns import col, half_even, lookup, state_of
from ..functions.quantiles import long_quantiles
from . import features
from .panel import over_time

LEVEL_RANK = {"free_flow": 0, "moderate": 1, "heavy": 2, "severe": 3}


def every_nth(df: DataFrame, start: str, cfg: Settings) -> DataFrame:
    """Every ``fit_every``-th slot counted from ``start``."""
    index = (F.unix_seconds("ts") - F.unix_seconds(slots.at(start))) / cfg.step_seconds
    return df.filter(F.pmod(index.cast("long"), F.lit(cfg.fit_every)) == 0)


def whole_window(df: DataFrame, start: str, end: str, horizon_min) -> DataFrame:
    """Rows of [start, end] whose label, ``horizon_min`` (a number or a column) later, does not reach beyond ``end``."""
    ahead = F.col("ts") + F.make_dt_interval(mins=horizon_min if isinstance(horizon_min, Column) else F.lit(horizon_min))
    return df.filter((F.col("ts") >= slots.at(start)) & (ahead <= slots.at(end)))


def window(df: DataFrame, start: str, end: str, horizon_min, cfg: Settings) -> DataFrame:
    """Sampled rows of :func:`whole_window`."""
    return every_nth(whole_window(df, start, end, horizon_min), start, cfg)


def bucket(ratio) -> Column:
    """Congested or normal; a missing ratio counts as normal."""
    return F.when(col(ratio) < conf.STATES[0][1], "congested").otherwise("normal")


# ---- training
def training_rows(panel: DataFrame, segments: DataFrame, context: DataFrame, edges: DataFrame, cfg: Settings, horizon_min: int) -> DataFrame:
    """Features and labels of one horizon side by side."""
    steps = cfg.horizons[horizon_min]
    x = features.build(panel, segments, context, edges, cfg, steps)
    return x.join(features.labels(panel, cfg, steps), ["segment_id", "ts"])


ROWS_PER_TASK = 30_000  # of a fit: every level of every tree is a job over all its tasks


def train(rows: DataFrame, metric: str, horizon_min: int, cfg: Settings, **params) -> PipelineModel:
    """Boosted trees on the change from now. Missing features take the column mean: the trees have no branch for NULL. The number of tasks
    follows the rows."""
    names = features.feature_names(cfg)
    usable = window(rows, cfg.start, cfg.fit_end, horizon_min, cfg).filter(F.col(f"delta_{metric}").isNotNull())
    usable = usable.coalesce(max(1, -(-usable.count() // ROWS_PER_TASK)))
    settings = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 50, "seed": 42} | params
    stages = [Imputer(inputCols=names, outputCols=names, strategy="mean"), VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
              GBTRegressor(featuresCol="features", labelCol=f"delta_{metric}", predictionCol="delta", **settings)]
    return Pipeline(stages=stages).fit(usable)


def predict(model: PipelineModel, rows: DataFrame, metric: str, horizon_min: int) -> DataFrame:
    """(segment_id, ts, metric, horizon_min, now, p50 unclipped)."""
    return model.transform(rows).select("segment_id", "ts", F.lit(metric).alias("metric"), F.lit(horizon_min).alias("horizon_min"),
                                        F.col(f"{metric}_now").alias("now"), (F.col(f"{metric}_now") + F.col("delta")).alias("p50"))


# ---- baselines and labels in long form
def _long(panel: DataFrame, cfg: Settings, value) -> DataFrame:
    """One row per cell, metric and horizon with the columns ``value(column, steps)`` returns."""
    items = []
    for metric, column in FORECAST_METRICS.items():
        for minutes, steps in cfg.horizons.items():
            items.append(F.struct(F.lit(metric).alias("metric"), F.lit(minutes).alias("horizon_min"), *value(column, steps)))
    return panel.select("segment_id", "ts", F.array(*items).alias("items")).select("segment_id", "ts", F.inline("items"))


def persistence(panel: DataFrame, cfg: Settings) -> DataFrame:
    return _long(panel, cfg, lambda c, k: (F.col(c).alias("now"), F.col(c).alias("p50")))


def daily_change(panel: DataFrame, cfg: Settings) -> DataFrame:
    """The value now plus the change that the same hours brought the day before; now itself where yesterday is not known. Horizons are below a day."""
    return _long(panel, cfg, lambda c, k: (F.col(c).alias("now"), changed(c, k, cfg).alias("p50")))


def changed(c: str, steps: int, cfg: Settings) -> Column:
    """The forecast of :func:`daily_change` for one column and horizon."""
    w = over_time()
    moved = F.lag(c, cfg.slots_per_day - steps).over(w) - F.lag(c, cfg.slots_per_day).over(w)
    return F.coalesce(F.col(c) + moved, F.col(c))


def recorded(panel: DataFrame, cfg: Settings) -> DataFrame:
    """LABELS: the value recorded at each horizon."""
    return _long(panel, cfg, lambda c, k: (F.col(c).alias("now"), later(c, k).alias("actual")))


def later(c: str, steps: int) -> Column:
    return F.lead(c, steps).over(over_time())


# ---- bands
def residual_bands(predicted: DataFrame, actual: DataFrame, ratios: DataFrame, cfg: Settings, sampled: bool = True) -> DataFrame:
    """(metric, horizon_min, bucket, lo, hi, n): 10th and 90th percentile of the residuals of the calibration window per traffic
    bucket, of every slot unless ``sampled``; a bucket with too few rows takes the pooled ones. The residuals span the network, so the
    quantiles are the bucketed ones."""
    span = (cfg.calib_start, cfg.train_end, F.col("horizon_min"))
    cut = (lambda df: window(df, *span, cfg)) if sampled else (lambda df: whole_window(df, *span))
    kept = (cut(predicted).join(cut(actual.drop("now")), ["segment_id", "ts", "metric", "horizon_min"])
            .join(ratios.select("segment_id", "ts", "speed_ratio"), ["segment_id", "ts"])
            .withColumns({"res": F.col("actual") - F.col("p50"), "bucket": bucket("speed_ratio")}).filter(F.col("res").isNotNull()))
    rows = kept.select("metric", "horizon_min", F.explode(F.array(F.col("bucket"), F.lit("pooled"))).alias("bucket"), "res")
    keys = ["metric", "horizon_min", "bucket"]
    found = long_quantiles(rows, keys, "res", F.array(F.struct(F.lit("lo").alias("name"), F.lit(0.1).alias("p")), F.struct(F.lit("hi").alias("name"), F.lit(0.9).alias("p"))))
    # One small row per metric and horizon holds all bounds; the buckets are laid out from it.
    part = lambda bucket_name, name, column: F.max(F.when((F.col("bucket") == bucket_name) & (F.col("name") == name), F.col(column)))
    figures = {f"{b}_{f}": part(b, name, column) for b in ("pooled", "normal", "congested")
               for f, name, column in (("lo", "lo", "quantile"), ("hi", "hi", "quantile"), ("n", "lo", "n"))}
    one = found.groupBy("metric", "horizon_min").agg(*[v.alias(k) for k, v in figures.items()])

    def laid_out(b):
        few = F.coalesce(F.col(f"{b}_n"), F.lit(0)) < cfg.band_min_rows
        return F.struct(F.lit(b).alias("bucket"), *[F.when(few, F.col(f"pooled_{f}")).otherwise(F.col(f"{b}_{f}")).alias(f) for f in ("lo", "hi", "n")])

    return one.select("metric", "horizon_min", F.inline(F.array(laid_out("normal"), laid_out("congested"))))


def with_bands(predicted: DataFrame, bands: DataFrame, ratios: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds p10 and p90 from the bands and clips everything to what the metric can be."""
    rows = (predicted.join(ratios.select("segment_id", "ts", "speed_ratio"), ["segment_id", "ts"], "left").withColumn("bucket", bucket("speed_ratio"))
            .join(bands.select("metric", "horizon_min", "bucket", "lo", "hi"), ["metric", "horizon_min", "bucket"], "left")
            .join(segments.select("segment_id", "free_flow_speed_kmh"), "segment_id"))
    return rows.select("segment_id", "ts", "metric", "horizon_min", "now", _clipped(F.col("p50")).alias("p50"), _clipped(F.col("p50") + F.col("lo")).alias("p10"),
                       _clipped(F.col("p50") + F.col("hi")).alias("p90"))


def _clipped(c: Column) -> Column:
    low = F.greatest(c, F.lit(0.0))
    return (F.when(c.isNull(), None).when(F.col("metric") == "speed", F.least(low, F.col("free_flow_speed_kmh")))
            .when(F.col("metric") == "congestion", F.least(low, F.lit(1.0))).otherwise(low))


# ---- from a forecast table
def forecast_states(forecast: DataFrame, segments: DataFrame) -> DataFrame:
    """State of every segment at each horizon."""
    ratio = F.col("p50") / F.col("free_flow_speed_kmh")
    return (forecast.filter("metric = 'speed'").join(segments.select("segment_id", "free_flow_speed_kmh"), "segment_id")
            .select("segment_id", "ts", "horizon_min", ratio.alias("ratio"), state_of(ratio).alias("state")))


def series(panel: DataFrame, forecast: DataFrame, t: str, cfg: Settings) -> DataFrame:
    """Per segment and metric at ``t``: the recorded history, the value now and the forecast, as one long table."""
    end = slots.at(t)
    start = slots.shift(end, -cfg.step_minutes * (cfg.forecast_history_slots - 1))
    past = slots.within(panel, start, end, cfg).select(
        "segment_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("ts").alias("at"), F.col(c).alias("value")) for m, c in FORECAST_METRICS.items()])))
    ahead = slots.within(forecast, end, end, cfg).select("segment_id", "metric", (F.col("ts") + F.make_dt_interval(mins=F.col("horizon_min"))).alias("at"), F.col("p50").alias("value"))
    return past.withColumn("kind", F.lit("history")).unionByName(ahead.withColumn("kind", F.lit("forecast")))


def overlay(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """The forecast with what was recorded later beside it, for looking back only."""
    return forecast.join(actual.drop("now"), ["segment_id", "ts", "metric", "horizon_min"], "left").withColumnRenamed("actual", "recorded_later")


def outlook(forecast: DataFrame, segments: DataFrame) -> DataFrame:
    """Per horizon: traffic level, confidence from the width of the band, and the trend of the worst horizon against now."""
    ff = F.col("free_flow_speed_kmh")
    rows = forecast.filter("metric = 'speed'").join(segments.select("segment_id", "free_flow_speed_kmh"), "segment_id")
    level = lambda c: lookup(state_of(c), conf.LEVEL_OF_STATE)
    width = F.coalesce((F.col("p90") - F.col("p10")) / ff, F.lit(1.0))
    rows = rows.filter(F.col("p50").isNotNull()).select(
        "segment_id", "ts", "horizon_min", level(F.col("now") / ff).alias("now_level"), level(F.col("p50") / ff).alias("level"),
        F.when(width < 0.15, "High").when(width < 0.3, "Medium").otherwise("Low").alias("confidence"))
    rank = lambda c: lookup(c, LEVEL_RANK, 0)
    worst = rows.groupBy("segment_id", "ts").agg(F.max(rank("level")).alias("worst"))
    return rows.join(worst, ["segment_id", "ts"]).withColumn(
        "trend", F.when(F.col("worst") > rank("now_level"), "worsening").when(F.col("worst") < rank("now_level"), "easing").otherwise("steady")).drop("worst")


RISING = 0.02


def rising(forecast: DataFrame, horizon_min: int) -> DataFrame:
    """(segment_id, ts, rising): whether congestion is expected to be clearly higher at a horizon than now; NULL without a forecast."""
    rows = forecast.filter((F.col("metric") == "congestion") & (F.col("horizon_min") == horizon_min))
    return rows.select("segment_id", "ts", (F.round(F.col("p50") - F.col("now"), 9) > RISING).alias("rising"))


def speed_trend(forecast: DataFrame, segments: DataFrame, horizon_min: int) -> DataFrame:
    """Worsening, recovering or stable: a change of more than five percent of the free-flow speed counts."""
    rows = (forecast.filter((F.col("metric") == "speed") & (F.col("horizon_min") == horizon_min))
            .join(segments.select("segment_id", "free_flow_speed_kmh"), "segment_id").filter("now IS NOT NULL AND p50 IS NOT NULL AND free_flow_speed_kmh > 0"))
    d = (F.col("p50") - F.col("now")) / F.col("free_flow_speed_kmh")
    return rows.select("segment_id", "ts", "now", F.col("p50").alias("later"), F.when(d < -0.05, "worsening").when(d > 0.05, "recovering").otherwise("stable").alias("trend"))


def near_term(wanted: DataFrame, snaps: DataFrame, outlooks: DataFrame, stats: DataFrame) -> DataFrame:
    """For listed segments: state now, level per horizon, and the historical peak. ``wanted``: (segment_id)."""
    ahead = outlooks.groupBy("segment_id", "ts").agg(F.array_sort(F.collect_list(F.struct("horizon_min", "level"))).alias("levels"), F.first("trend").alias("trend"))
    return (wanted.join(snaps.select("segment_id", "ts", "state"), "segment_id").join(ahead, ["segment_id", "ts"], "left")
            .join(stats.select("segment_id", half_even("peak_flow_vph").alias("peak_flow_vph"), half_even("peak_speed_kmh", 1).alias("peak_speed_kmh"),
                               half_even(F.col("utilization") * 100).alias("peak_utilization_pct")), "segment_id", "left"))
