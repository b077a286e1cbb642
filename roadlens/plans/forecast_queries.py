"""Queries over forecasts, evaluation, robustness and streams."""

from __future__ import annotations

import re
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..conf import FORECAST_METRICS, VALUE_COLUMNS
from ..functions import slots
from ..operators import detect, diagnose, evaluate, forecast, graph, robustness
from ..sources.workspace import fresh_path, written
from ..streaming import live
from .corridor_queries import RANKING_SQL, STATS
from .detect_queries import _BN, _CENTRES, _EVENTS, _RUNS, _SHAPES, TYPE_SQL
from .oracle_views import VIEWS
from .registry import query

# ---- forecasts
_M = (("speed", "speed_kmh"), ("flow", "flow_vph"), ("congestion", "congestion_index"))
_H = ((360, 1), (720, 2), (1080, 3))
FC = {
    "fc0": " UNION ALL ".join(f"SELECT segment_id, ts, '{m}' AS metric, {h} AS horizon_min, {c} AS now, lead({c}, {k}) OVER (PARTITION BY segment_id ORDER BY ts) AS actual, "
                              f"coalesce({c} + lag({c}, {4 - k}) OVER (PARTITION BY segment_id ORDER BY ts) - lag({c}, 4) OVER (PARTITION BY segment_id ORDER BY ts), {c}) AS daily FROM panel"
                              for m, c in _M for h, k in _H),
    "res0": """
SELECT metric, horizon_min, CASE WHEN r.speed_ratio < 0.85::DOUBLE THEN 'congested' ELSE 'normal' END AS bucket, actual - now AS res
FROM fc0 f JOIN ratios r USING (segment_id, ts) WHERE f.ts >= TIMESTAMP '2024-01-20 00:00:00' AND f.ts + INTERVAL 1 MINUTE * horizon_min <= TIMESTAMP '2024-01-24 18:00:00'
  AND (date_diff('hour', TIMESTAMP '2024-01-20 00:00:00', f.ts) // 6) % 3 = 0 AND actual - now IS NOT NULL""",
    "own_b": "SELECT metric, horizon_min, bucket, quantile_cont(res, 0.1) AS lo, quantile_cont(res, 0.9) AS hi, count(*) AS n FROM res0 GROUP BY ALL",
    "pool_b": "SELECT metric, horizon_min, quantile_cont(res, 0.1) AS lo, quantile_cont(res, 0.9) AS hi, count(*) AS n FROM res0 GROUP BY ALL",
    "bands": """
SELECT p.metric, p.horizon_min, k.bucket, CASE WHEN coalesce(o.n, 0) < 50 THEN p.lo ELSE o.lo END AS lo, CASE WHEN coalesce(o.n, 0) < 50 THEN p.hi ELSE o.hi END AS hi,
  CASE WHEN coalesce(o.n, 0) < 50 THEN p.n ELSE o.n END AS n
FROM pool_b p, (VALUES ('normal'), ('congested')) k(bucket) LEFT JOIN own_b o ON o.metric = p.metric AND o.horizon_min = p.horizon_min AND o.bucket = k.bucket"""}


def _banded(p50: str) -> str:
    clip = lambda x: (f"CASE WHEN {x} IS NULL THEN NULL WHEN f.metric = 'speed' THEN least(greatest({x}, 0), free_flow_speed_kmh) "
                      f"WHEN f.metric = 'congestion' THEN least(greatest({x}, 0), 1) ELSE greatest({x}, 0) END")
    return f"""
SELECT f.segment_id, f.ts, f.metric, f.horizon_min, f.now, f.actual, r.speed_ratio, free_flow_speed_kmh, {clip(p50)} AS p50, {clip(p50 + ' + lo')} AS p10, {clip(p50 + ' + hi')} AS p90
FROM fc0 f JOIN ratios r USING (segment_id, ts) JOIN bands b ON b.metric = f.metric AND b.horizon_min = f.horizon_min
  AND b.bucket = CASE WHEN r.speed_ratio < 0.85::DOUBLE THEN 'congested' ELSE 'normal' END"""


FC |= {"pers": _banded("f.now"), "seas": _banded("f.daily")}
_FCOLS = "segment_id:s ts:t metric:s horizon_min:i now:d p50:d p10:d p90:d"
query("persistence_forecast", "segment_id:s ts:t metric:s horizon_min:i p50:d", "SELECT segment_id, ts, metric, horizon_min, now AS p50 FROM fc0", **FC)(
    lambda c: forecast.persistence(c.panel, c.cfg))
query("recorded_future", "segment_id:s ts:t metric:s horizon_min:i now:d actual:d", "SELECT * FROM fc0", **FC)(lambda c: forecast.recorded(c.panel, c.cfg))
query("residual_bands", "metric:s horizon_min:i bucket:s lo:d hi:d n:i", "SELECT * FROM bands", **FC)(
    lambda c: forecast.residual_bands(forecast.persistence(c.panel, c.cfg), c.recorded, c.ratios, c.cfg))
query("forecast_bands", _FCOLS, "SELECT * FROM pers", **FC)(lambda c: c.persistence)
query("forecast_overlay", _FCOLS + " recorded_later:d", "SELECT *, actual AS recorded_later FROM pers", **FC)(lambda c: forecast.overlay(c.persistence, c.recorded))
_ST = "CASE WHEN {0} >= 0.85::DOUBLE THEN 'NORMAL' WHEN {0} >= 0.70::DOUBLE THEN 'MODERATE' WHEN {0} >= 0.50::DOUBLE THEN 'HEAVY' WHEN {0} >= 0 THEN 'CRITICAL' ELSE 'NO_DATA' END"
query("forecast_map", "segment_id:s ts:t horizon_min:i ratio:d state:s", f"""
SELECT segment_id, ts, horizon_min, p50 / free_flow_speed_kmh AS ratio, {_ST.format('p50 / free_flow_speed_kmh')} AS state FROM seas WHERE metric = 'speed'""", **FC)(
    lambda c: forecast.forecast_states(c.daily_forecast, c.segments))
query("forecast_series", "segment_id:s metric:s at:t value:d kind:s", " UNION ALL ".join(
    f"SELECT segment_id, '{m}' AS metric, ts AS at, {c} AS value, 'history' AS kind FROM panel WHERE ts BETWEEN TIMESTAMP '2024-01-26 12:00:00' - INTERVAL 144 HOUR AND TIMESTAMP '2024-01-26 12:00:00'"
    for m, c in _M) + " UNION ALL SELECT segment_id, metric, ts + INTERVAL 1 MINUTE * horizon_min, p50, 'forecast' FROM pers WHERE ts = TIMESTAMP '2024-01-26 12:00:00'", **FC)(
    lambda c: forecast.series(c.dated_panel, c.persistence_at(c.AS_OF), c.AS_OF, c.cfg))
_LV = "CASE WHEN {0} >= 0.85::DOUBLE THEN 'free_flow' WHEN {0} >= 0.70::DOUBLE THEN 'moderate' WHEN {0} >= 0.50::DOUBLE THEN 'heavy' WHEN {0} >= 0 THEN 'severe' ELSE 'no_data' END"
_RK = "CASE {0} WHEN 'moderate' THEN 1 WHEN 'heavy' THEN 2 WHEN 'severe' THEN 3 ELSE 0 END"
_OUTLOOK = f"""
SELECT *, CASE WHEN worst > {_RK.format('now_level')} THEN 'worsening' WHEN worst < {_RK.format('now_level')} THEN 'easing' ELSE 'steady' END AS trend FROM (
SELECT *, max({_RK.format('level')}) OVER (PARTITION BY segment_id, ts) AS worst FROM (
SELECT segment_id, ts, horizon_min, {_LV.format('now / free_flow_speed_kmh')} AS now_level, {_LV.format('p50 / free_flow_speed_kmh')} AS level,
  CASE WHEN coalesce((p90 - p10) / free_flow_speed_kmh, 1) < 0.15 THEN 'High' WHEN coalesce((p90 - p10) / free_flow_speed_kmh, 1) < 0.3 THEN 'Medium' ELSE 'Low' END AS confidence
FROM seas WHERE metric = 'speed' AND p50 IS NOT NULL))"""
_EVERY = {**FC, "res0": """
SELECT metric, horizon_min, CASE WHEN r.speed_ratio < 0.85::DOUBLE THEN 'congested' ELSE 'normal' END AS bucket, actual - now AS res
FROM fc0 f JOIN ratios r USING (segment_id, ts) WHERE f.ts >= TIMESTAMP '2024-01-20 00:00:00' AND f.ts + INTERVAL 1 MINUTE * horizon_min <= TIMESTAMP '2024-01-24 18:00:00'
  AND actual - now IS NOT NULL"""}
query("forecast_outlook", "segment_id:s ts:t horizon_min:i now_level:s level:s confidence:s trend:s", _OUTLOOK, **_EVERY)(lambda c: forecast.outlook(c.outlook_forecast, c.segments))
query("speed_trend", "segment_id:s ts:t now:d later:d trend:s", """
SELECT segment_id, ts, now, p50 AS later, CASE WHEN (p50 - now) / free_flow_speed_kmh < -0.05 THEN 'worsening' WHEN (p50 - now) / free_flow_speed_kmh > 0.05 THEN 'recovering' ELSE 'stable' END AS trend
FROM seas WHERE metric = 'speed' AND horizon_min = 720 AND now IS NOT NULL AND p50 IS NOT NULL""", **FC)(lambda c: forecast.speed_trend(c.daily_forecast, c.segments, 720))
query("near_term_outlook", "segment_id:s ts:t state:s levels:s trend:s peak_flow_vph:d peak_speed_kmh:d peak_utilization_pct:d", """
SELECT c.segment_id, c.ts, c.state, coalesce(o.levels, '') AS levels, o.trend, round_even(s.peak_flow_vph, 0) AS peak_flow_vph, round_even(s.peak_speed_kmh, 1) AS peak_speed_kmh,
  round_even(s.utilization * 100, 0) AS peak_utilization_pct
FROM components c LEFT JOIN (SELECT segment_id, ts, string_agg(level, ',' ORDER BY horizon_min) AS levels, any_value(trend) AS trend FROM outlook GROUP BY ALL) o
  ON o.segment_id = c.segment_id AND o.ts = c.ts JOIN seg_stats s ON s.segment_id = c.segment_id""", outlook=_OUTLOOK, **FC, **STATS)(
    lambda c: forecast.near_term(c.segments.select("segment_id"), c.snapshots, forecast.outlook(c.daily_forecast, c.segments), c.segment_stats)
    .withColumn("levels", F.concat_ws(",", F.transform("levels", lambda x: x["level"]))))


MODELS_AT_ONCE = 9  # a fit has few tasks: together they fill the cores


def _fitted(c):
    """Boosted trees of every metric and horizon: fitted on the first days, bands from the calibration days. The fits are independent, so
    a few run at the same time; each is written, and the table of all is kept for the life of the city."""
    if not hasattr(c, "tree_forecast"):
        rows = {h: written(forecast.training_rows(c.panel, c.segments, c.context, c.edges, c.cfg, h), "training") for h in c.cfg.horizons}

        def one(job):
            metric, horizon = job
            return written(forecast.predict(forecast.train(rows[horizon], metric, horizon, c.cfg), rows[horizon], metric, horizon), "predicted")
        with ThreadPool(MODELS_AT_ONCE) as pool:
            parts = pool.map(inheritable_thread_target(one), [(m, h) for m in FORECAST_METRICS for h in c.cfg.horizons])
        predicted = parts[0]
        for p in parts[1:]:
            predicted = predicted.unionByName(p)
        bands = forecast.residual_bands(predicted, c.recorded, c.ratios, c.cfg)
        c.tree_forecast = written(forecast.with_bands(predicted, bands, c.ratios, c.segments), "tree_forecast")
    return c.tree_forecast


query("boosted_tree_forecast", _FCOLS)(_fitted)
query("boosted_tree_metrics", "metric:s horizon_min:i model_mae:d persistence_mae:d improvement_pct:d coverage:d model_n:i")(
    lambda c: evaluate.forecast_metrics(_fitted(c), c.recorded, c.ratios, c.cfg.val_start, c.cfg.val_end))

# ---- evaluation
_ERR = lambda p, y, yh: (f"avg(abs({yh} - {y})) AS {p}mae, sqrt(avg(({yh} - {y}) * ({yh} - {y}))) AS {p}rmse, count({yh} - {y}) AS {p}n, "
                         f"avg(CASE WHEN abs({y}) > 1e-6 THEN abs(({yh} - {y}) / {y}) END) * 100 AS {p}mape_pct")
_MET = ("metric:s horizon_min:i persistence_mae:d persistence_rmse:d persistence_n:i persistence_mape_pct:d busy_persistence_mae:d busy_persistence_n:i improvement_pct:d coverage:d")
query("forecast_metrics", _MET, f"""
SELECT *, CASE WHEN persistence_mae <> 0 THEN (1 - model_mae / persistence_mae) * 100 END AS improvement_pct FROM (
SELECT metric, horizon_min, {_ERR('model_', 'actual', 'p50')}, {_ERR('persistence_', 'actual', 'now')},
  avg(CASE WHEN speed_ratio < 0.85::DOUBLE THEN abs(now - actual) END) AS busy_persistence_mae, count(CASE WHEN speed_ratio < 0.85::DOUBLE THEN now - actual END) AS busy_persistence_n,
  avg(CASE WHEN actual IS NULL THEN NULL WHEN actual BETWEEN p10 AND p90 THEN 1 ELSE 0 END) AS coverage
FROM pers WHERE ts BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '2024-01-30 18:00:00' GROUP BY ALL)""", **FC)(
    lambda c: evaluate.forecast_metrics(c.persistence, c.recorded, c.ratios, c.cfg.val_start, c.cfg.val_end))


def _split_sql(name: str, a: str, b: str, days: int) -> str:
    return f"""
SELECT '{name}' AS split, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1, fp::DOUBLE / {days} AS fp_per_day
FROM (SELECT count(*) FILTER (anomalous AND l) AS tp, count(*) FILTER (anomalous AND NOT l) AS fp, count(*) FILTER (NOT anomalous AND l) AS fn FROM (
  SELECT c.anomalous, i.ts IS NOT NULL AS l FROM components c ANTI JOIN rw_slots w ON w.segment_id = c.segment_id AND w.ts = c.ts
  LEFT JOIN inc_mask i ON i.segment_id = c.segment_id AND i.ts = c.ts WHERE c.ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'))"""


def _splits(c):
    spans = {"train": (c.cfg.start, c.cfg.train_end), "validation": (c.cfg.val_start, c.cfg.val_end)}
    out = None
    for name, (a, b) in spans.items():
        part = evaluate.slot_level(c.components, c.incident_mask, c.roadwork_mask, a, b, c.cfg).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


query("prf_slots", "split:s tp:i fp:i fn:i precision:d recall:d f1:d fp_per_day:d",
      _split_sql("train", "2024-01-01 00:00:00", "2024-01-24 18:00:00", 24) + " UNION ALL " + _split_sql("validation", "2024-01-25 00:00:00", "2024-01-30 18:00:00", 6))(_splits)
_HITS = """
SELECT i.incident_id, i.segment_id, i.incident_type, min(c.ts) FILTER (c.anomalous) AS first_hit,
  (epoch_us(min(c.ts) FILTER (c.anomalous)) - epoch_us(any_value(i.start_time))) / 60e6 AS delay_min
FROM inc_slots i JOIN components c ON c.segment_id = i.segment_id AND c.ts = i.ts GROUP BY 1, 2, 3"""
query("incident_hits", "incident_id:s segment_id:s incident_type:s first_hit:t delay_min:d", "SELECT * FROM hits", hits=_HITS)(
    lambda c: evaluate.incident_hits(c.incidents, c.components, c.cfg))
query("event_level", "incidents:i detected:i median_delay_min:d event_recall:d events:i unmatched_events:i unmatched_per_day:d", """
SELECT *, detected::DOUBLE / incidents AS event_recall, unmatched_events / 30::DOUBLE AS unmatched_per_day FROM (
SELECT (SELECT count(*) FROM incidents) AS incidents, (SELECT count(first_hit) FROM hits) AS detected, (SELECT median(delay_min) FROM hits) AS median_delay_min,
  (SELECT count(*) FROM evs) AS events, (SELECT count(*) FROM evs e WHERE NOT EXISTS (
    SELECT 1 FROM labelled l WHERE l.segment_id = e.segment_id AND l.ts BETWEEN e.start AND e."end")) AS unmatched_events)""", hits=_HITS, runs=_RUNS, evs=_EVENTS)(
    lambda c: evaluate.event_level(c.incidents, c.components, c.labelled, c.cfg.start, c.cfg.end, c.cfg))


def _judged(c):
    hits = evaluate.incident_hits(c.incidents, c.components, c.cfg).filter("first_hit IS NOT NULL")
    span = detect.label_slots(c.incidents, c.cfg, ("incident_id",)).join(hits.select("incident_id", "first_hit", "incident_type"), "incident_id").filter("ts >= first_hit")
    change = F.col("flow_ratio") / F.when(F.col("fr_med").isNotNull(), F.greatest("fr_med", F.lit(1e-3))) - 1
    shapes = (span.join(c.components.select("segment_id", "ts", "drop", change.alias("flow_change")), ["segment_id", "ts"]).groupBy("incident_id", "incident_type")
              .agg(F.avg("drop").alias("mean_drop"), F.avg("flow_change").alias("mean_flow_change")).filter("mean_drop IS NOT NULL AND mean_flow_change IS NOT NULL"))
    return diagnose.type_likelihood(shapes, c.centroids)


_HITSHAPES = """
SELECT i.incident_id, avg(drop) AS mean_drop, avg(flow_ratio / CASE WHEN fr_med IS NULL THEN NULL ELSE greatest(fr_med, 0.001::DOUBLE) END - 1) AS mean_flow_change
FROM inc_slots i JOIN hits h ON h.incident_id = i.incident_id AND i.ts >= h.first_hit JOIN components c ON c.segment_id = i.segment_id AND c.ts = i.ts
GROUP BY 1 HAVING count(drop) > 0 AND count(flow_ratio / fr_med) > 0"""
query("type_accuracy", "incident_type:s n:i correct:i unknown:i accuracy:d unknown_rate:d", """
SELECT *, correct::DOUBLE / n AS accuracy, unknown::DOUBLE / n AS unknown_rate FROM (
SELECT incident_type, count(*) AS n, count(*) FILTER (incident_type = likely_type) AS correct, count(*) FILTER (likely_type = 'UNKNOWN') AS unknown FROM judged_hits GROUP BY 1
UNION ALL SELECT 'all', count(*), count(*) FILTER (incident_type = likely_type), count(*) FILTER (likely_type = 'UNKNOWN') FROM judged_hits)""", hits=_HITS, shapes=_SHAPES, centres=_CENTRES, hit_shapes=_HITSHAPES,
      judged_hits="SELECT h.incident_type, t.likely_type FROM judged_types t JOIN hits h USING (incident_id)", judged_types=TYPE_SQL.format(id="incident_id", ids="h.incident_id", shapes="hit_shapes"))(lambda c: evaluate.type_accuracy(_judged(c)))
query("absent_types", "incident_type:s", "SELECT DISTINCT incident_type FROM inc_train EXCEPT SELECT incident_type FROM inc_val")(
    lambda c: evaluate.absent_types(c.in_validation(c.incidents), c.in_train(c.incidents)))
query("bottleneck_quality", "threshold:d tp:i fp:i fn:i flagged:i precision:d recall:d f1:d", """
SELECT *, tp + fp AS flagged, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (
SELECT z.threshold, count(*) FILTER (coalesce(robust_z <= z.threshold, false) AND structural_bottleneck = 1) AS tp,
  count(*) FILTER (coalesce(robust_z <= z.threshold, false) AND structural_bottleneck = 0) AS fp,
  count(*) FILTER (NOT coalesce(robust_z <= z.threshold, false) AND structural_bottleneck = 1) AS fn
FROM bottlenecks JOIN segments USING (segment_id), (VALUES (-1.5), (-2.0), (-2.5), (-3.0)) z(threshold) GROUP BY 1)""", **_BN)(
    lambda c: evaluate.bottleneck_quality(c.bottlenecks, c.segments))
query("bottleneck_ranking", "auc:d precision_at_k:d hits_at_k:d k:i segments:i", f"""
SELECT *, precision_at_k * k AS hits_at_k FROM ({RANKING_SQL.format(kind="'throughput'", expr="-robust_z", rows="bottlenecks JOIN segments USING (segment_id) WHERE robust_z IS NOT NULL")})""", **_BN)(
    lambda c: evaluate.bottleneck_ranking(c.bottlenecks, c.segments).withColumn("hits_at_k", F.col("precision_at_k") * F.col("k")))


# ---- robustness
def _draw(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}-7-' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _version_sql(kind: str, seq: str) -> str:
    on = lambda name: kind in (name, "combined")
    v = {c: c for c in VALUE_COLUMNS}
    if on("missing"):
        v = {c: f"CASE WHEN {_draw(f'null-{c}', 'ingest_seq')} >= 0.025::DOUBLE THEN {x} END" for c, x in v.items()}
    if on("spikes"):
        v["flow_vph"] = f"CASE WHEN {_draw('flow', seq)} < 0.01::DOUBLE THEN ({v['flow_vph']}) * (4 + 4 * {_draw('flow-size', seq)}) + 2000 ELSE {v['flow_vph']} END"
        v["occupancy_pct"] = f"CASE WHEN {_draw('occupancy', seq)} < 0.01::DOUBLE THEN 120 + 180 * {_draw('occupancy-size', seq)} ELSE {v['occupancy_pct']} END"
    if on("stuck"):
        v = {c: f"CASE WHEN in_block THEN held_{c} ELSE {x} END" for c, x in v.items()}
    if on("negatives"):
        v |= {c: f"CASE WHEN {_draw(f'negative-{c}', seq)} < 0.05::DOUBLE / 3 THEN -abs({v[c]}) ELSE {v[c]} END" for c in ("speed_kmh", "flow_vph", "occupancy_pct")}
    order = f"('0x' || substr(md5('shuffle-7-' || CAST({seq} AS VARCHAR)), 1, 15))::BIGINT" if on("shuffle") else seq
    lost = f"{_draw('drop', 'ingest_seq')} >= 0.05::DOUBLE" if on("missing") else "true"
    again = f" AND {_draw('again', 'ingest_seq')} < 0.05::DOUBLE" if seq != "ingest_seq" else ""
    return f"SELECT segment_id, ts, sensor_quality, '{kind}' AS scenario, {order} AS ingest_seq, " + ", ".join(f"{x} AS {c}" for c, x in v.items()) + f" FROM blocked WHERE {lost}{again}"


_SCENARIOS = ("clean", *robustness.KINDS)
_BEGIN = f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 6 HOUR * CAST(floor({_draw('stuck-at', 'segment_id')} * 95) AS BIGINT)"
_NOISY = {
    "blocks": f"SELECT *, {_draw('stuck', 'segment_id')} < 0.05::DOUBLE AND ts BETWEEN {_BEGIN} AND {_BEGIN} + INTERVAL 138 HOUR AS in_block FROM readings",
    "held": "SELECT segment_id, " + ", ".join(f"{c} AS held_{c}" for c in VALUE_COLUMNS)
            + " FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ts, ingest_seq) AS rn FROM blocks WHERE in_block) WHERE rn = 1",
    "blocked": "SELECT * FROM blocks LEFT JOIN held USING (segment_id)",
    "noisy": " UNION ALL ".join([_version_sql("clean", "ingest_seq"), *[_version_sql(k, "ingest_seq") for k in robustness.KINDS],
                                 *[_version_sql(k, "(ingest_seq + 1099511627776)") for k in ("duplicates", "combined")]])}
query("corruption_counts", "scenario:s rows:i null_speed:i negative_flow:i occupancy_over_100:i cells:i", """
SELECT scenario, count(*) AS rows, count(*) FILTER (speed_kmh IS NULL) AS null_speed, count(*) FILTER (flow_vph < 0) AS negative_flow,
  count(*) FILTER (occupancy_pct > 100) AS occupancy_over_100, count(DISTINCT (segment_id, ts)) AS cells FROM noisy GROUP BY 1""", **_NOISY)(
    lambda c: robustness.scenario_readings(c.readings, c.cfg).groupBy("scenario").agg(
        F.count("*").alias("rows"), F.count_if(F.col("speed_kmh").isNull()).alias("null_speed"), F.count_if(F.col("flow_vph") < 0).alias("negative_flow"),
        F.count_if(F.col("occupancy_pct") > 100).alias("occupancy_over_100"), F.countDistinct("segment_id", "ts").alias("cells")))


def _targets(cfg):
    """Every metric at the first horizon, speed and congestion at the last."""
    first, last = min(cfg.horizons), max(cfg.horizons)
    return [("speed", first), ("flow", first), ("congestion", first), ("speed", last), ("congestion", last)]


def _robustness(c):
    """Every figure is one of the validation days. What they need is kept of the panels, which are made from all readings: these days, and the day before
    for the forecast."""
    cfg, keys = c.cfg, ["pipeline", "scenario"]
    first = slots.shift(slots.at(cfg.val_start), -cfg.step_minutes * cfg.slots_per_day)
    panels = written(slots.within(robustness.scenario_panels(c.readings, c.segments, cfg), first, None, cfg), "scenario_panels")
    rows = robustness.per_scenario(slots.within(panels, slots.at(cfg.val_start), None, cfg), c.segments)
    static = c.segments.select(F.col("segment_id").alias("base_id"), "free_flow_speed_kmh", "capacity_vph")
    ratios = detect.with_daytype(rows.join(static, "base_id").withColumns({
        "speed_ratio": F.col("speed_kmh") / F.col("free_flow_speed_kmh"), "flow_ratio": F.col("flow_vph") / F.col("capacity_vph")}), c.context)
    base = c.baseline.withColumnRenamed("segment_id", "base_id")
    drops = ratios.withColumn("hour", F.hour("ts").cast("long")).join(base, ["base_id", "hour", "daytype"], "left").withColumn("drop", F.col("sr_med") - F.col("speed_ratio"))
    drops = written(drops.select(*keys, "base_id", "ts", "drop", "quality"), "scenario_drops")
    shift = detect.network_shift(drops.withColumn("ts", F.struct(*keys, "ts")))
    local = drops.join(shift.select("ts.*", "net_shift"), [*keys, "ts"], "left").withColumn("local_drop", F.coalesce(F.col("drop") - F.col("net_shift"), F.lit(0.0)))
    local = local.select(F.col("base_id").alias("segment_id"), F.struct(*keys, "ts").alias("ts"), "local_drop", "quality")
    around = graph.neighbor_stat(local.select("segment_id", "ts", "local_drop"), c.edges, [F.max("local_drop").alias("neighbor_max_drop")])
    flagged = (local.join(around, ["segment_id", "ts"], "left").withColumn("neighbor_max_drop", F.coalesce("neighbor_max_drop", F.lit(0.0)))
               .withColumn("score", detect.score("drop_epicentre")).withColumn("anomalous", F.col("score") >= cfg.threshold))
    flagged = written(flagged.select("segment_id", "ts.*", "score", "anomalous", "quality"), "scenario_flags")
    span = lambda df: slots.within(df, slots.at(cfg.val_start), slots.at(cfg.val_end), cfg)
    prf = evaluate.slot_level(flagged, c.incident_mask, c.roadwork_mask, cfg.val_start, cfg.val_end, cfg, keys)
    scored = span(flagged)
    mean = scored.groupBy(*keys).agg(F.avg("quality").alias("quality"))
    sure = scored.join(c.incident_mask, ["segment_id", "ts"]).groupBy(*keys).agg(F.avg(detect.confidence(F.col("score"), cfg.threshold, F.col("quality"))).alias("confidence"))
    incidents = c.in_validation(c.incidents)
    found = (detect.label_slots(incidents, cfg, ("incident_id",)).join(flagged.filter("anomalous").select(*keys, "segment_id", "ts"), ["segment_id", "ts"])
             .groupBy(*keys).agg(F.countDistinct("incident_id").alias("found")))
    # forecasts of all targets and what was recorded later stand side by side in the row of a cell
    targets = {f"{m}_{h}": (FORECAST_METRICS[m], cfg.horizons[h]) for m, h in _targets(cfg)}
    actual = span(c.panel.select("segment_id", "ts", *[forecast.later(x, k).alias(f"actual_{t}") for t, (x, k) in targets.items()])).withColumnRenamed("segment_id", "base_id")
    ahead = span(panels.select("segment_id", "ts", *[forecast.changed(x, k, cfg).alias(f"p50_{t}") for t, (x, k) in targets.items()]))
    ahead = robustness.per_scenario(ahead, c.segments).join(actual.hint("merge"), ["base_id", "ts"])
    columns = []
    for t in targets:
        error = F.abs(F.col(f"p50_{t}") - F.col(f"actual_{t}"))
        columns += [F.avg(error).alias(f"mae_{t}"), F.avg(error.isNotNull().cast("double")).alias(f"coverage_{t}")]
    errors = ahead.groupBy(*keys).agg(*columns)
    return (prf.join(mean, keys).join(errors, keys).join(sure, keys, "left").join(found, keys, "left")
            .withColumns({"found": F.coalesce("found", F.lit(0)), "incidents": F.lit(incidents.count())}))


# the same steps as for the readings themselves, over segment ids that name their scenario
_OF = lambda view: re.sub(r"\b(readings|segments|dedup|cells|same0|runs0|judged|panel)\b", r"sc_\1", VIEWS[view])
_PARTS = "*, split_part(segment_id, '|', 1) AS scenario, split_part(segment_id, '|', 2) AS base_id"
_ROBUST = {**_NOISY, **FC,
    "sc_readings": "SELECT * REPLACE (scenario || '|' || segment_id AS segment_id) FROM noisy",
    "sc_segments": "SELECT k.scenario || '|' || segment_id AS segment_id, free_flow_speed_kmh, capacity_vph FROM segments, (VALUES " + ", ".join(f"('{k}')" for k in _SCENARIOS) + ") k(scenario)",
    **{f"sc_{v}": _OF(v) for v in ("dedup", "cells", "same0", "runs0", "judged", "panel")},
    "sc_last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, ts ORDER BY ingest_seq DESC) AS rn FROM sc_readings) WHERE rn = 1",
    "sc_naive": "SELECT g.segment_id, t.ts, " + ", ".join(f"l.{c}" for c in VALUE_COLUMNS) + """, l.speed_kmh IS NOT NULL AS valid,
  avg(CASE WHEN l.speed_kmh IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY g.segment_id ORDER BY t.ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS quality
FROM sc_segments g CROSS JOIN slots t LEFT JOIN sc_last l ON l.segment_id = g.segment_id AND l.ts = t.ts""",
    "sc_all": f"SELECT 'sanitized' AS pipeline, {_PARTS} FROM sc_panel UNION ALL SELECT 'naive', {_PARTS} FROM sc_naive",
    "sc_drops": """
SELECT p.*, b.sr_med - p.speed_kmh / s.free_flow_speed_kmh AS drop FROM sc_all p JOIN segments s ON s.segment_id = p.base_id LEFT JOIN context x ON x.ts = p.ts
LEFT JOIN baseline b ON b.segment_id = p.base_id AND b.hour = hour(p.ts) AND b.daytype = CASE WHEN isodow(p.ts) >= 6 OR x.holiday_flag > 0 THEN 1 ELSE 0 END""",
    "sc_shift": "SELECT pipeline, scenario, ts, greatest(median(drop), 0) AS net_shift FROM sc_drops GROUP BY ALL HAVING count(drop) > 0",
    "sc_local": "SELECT d.pipeline, d.scenario, d.base_id, d.ts, d.quality, coalesce(drop - net_shift, 0) AS local_drop FROM sc_drops d LEFT JOIN sc_shift USING (pipeline, scenario, ts)",
    "sc_near": "SELECT l.pipeline, l.scenario, e.segment_id AS base_id, l.ts, max(l.local_drop) AS top FROM edges e JOIN sc_local l ON l.base_id = e.neighbor_id GROUP BY ALL",
    "sc_flags": """
SELECT *, score >= 0.2::DOUBLE AS anomalous FROM (SELECT l.pipeline, l.scenario, l.base_id AS segment_id, l.ts, l.quality,
  CASE WHEN l.local_drop >= coalesce(n.top, 0) THEN l.local_drop ELSE 0 END AS score FROM sc_local l LEFT JOIN sc_near n USING (pipeline, scenario, base_id, ts))""",
    "sc_span": """
SELECT f.*, i.ts IS NOT NULL AS label, w.ts IS NOT NULL AS works FROM sc_flags f LEFT JOIN inc_mask i ON i.segment_id = f.segment_id AND i.ts = f.ts
LEFT JOIN rw_slots w ON w.segment_id = f.segment_id AND w.ts = f.ts WHERE f.ts BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '2024-01-30 18:00:00'""",
    "sc_prf": """
SELECT pipeline, scenario, count(*) FILTER (NOT works AND anomalous AND label) AS tp, count(*) FILTER (NOT works AND anomalous AND NOT label) AS fp, count(*) FILTER (NOT works AND NOT anomalous AND label) AS fn,
  avg(quality) AS quality, avg((1 / (1 + exp(-(score - 0.2::DOUBLE) / (0.25::DOUBLE * 0.2::DOUBLE)))) * quality) FILTER (label) AS confidence FROM sc_span GROUP BY ALL""",
    "sc_found": """
SELECT pipeline, scenario, count(DISTINCT incident_id) AS found FROM sc_flags f JOIN inc_slots i ON i.segment_id = f.segment_id AND i.ts = f.ts
WHERE f.anomalous AND i.start_time >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL""",
    "sc_ahead": " UNION ALL ".join(
        f"SELECT pipeline, scenario, base_id, ts, '{m}' AS metric, {h} AS horizon_min, coalesce({x} + lag({x}, {4 - k}) OVER w - lag({x}, 4) OVER w, {x}) AS p50 "
        "FROM sc_all WINDOW w AS (PARTITION BY pipeline, segment_id ORDER BY ts)" for m, x in _M for h, k in _H),
    "sc_errors": "SELECT pipeline, scenario, " + ", ".join(
        f"avg(abs(p50 - actual)) FILTER (a.metric = '{m}' AND a.horizon_min = {h}) AS mae_{m}_{h}, "
        f"avg(CASE WHEN p50 - actual IS NOT NULL THEN 1 ELSE 0 END) FILTER (a.metric = '{m}' AND a.horizon_min = {h}) AS coverage_{m}_{h}" for m, h in (("speed", 360), ("flow", 360), ("congestion", 360), ("speed", 1080), ("congestion", 1080)))
        + """ FROM sc_ahead a JOIN fc0 f ON f.segment_id = a.base_id AND f.ts = a.ts AND f.metric = a.metric AND f.horizon_min = a.horizon_min
WHERE a.ts BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '2024-01-30 18:00:00' GROUP BY ALL"""}
_TARGET_COLUMNS = " ".join(f"mae_{m}_{h}:d coverage_{m}_{h}:d" for m, h in (("speed", 360), ("flow", 360), ("congestion", 360), ("speed", 1080), ("congestion", 1080)))
query("robustness", f"pipeline:s scenario:s tp:i fp:i fn:i f1:d fp_per_day:d found:i incidents:i quality:d confidence:d {_TARGET_COLUMNS}", """
SELECT p.*, e.* EXCLUDE (pipeline, scenario), CASE WHEN tp > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1, fp / 6::DOUBLE AS fp_per_day, coalesce(found, 0) AS found,
  (SELECT count(*) FROM inc_val) AS incidents
FROM sc_prf p JOIN sc_errors e ON e.pipeline = p.pipeline AND e.scenario = p.scenario LEFT JOIN sc_found f ON f.pipeline = p.pipeline AND f.scenario = p.scenario""", **_ROBUST)(_robustness)


# ---- streams: each result is written by a streaming query over the event files, then read back
def _streamed(c, result, name):
    path, checkpoint = fresh_path(c.spark, name), fresh_path(c.spark, f"{name}-checkpoint")
    live.to_table(result, path, checkpoint).awaitTermination()
    return c.spark.read.schema(result.schema).parquet(path)


query("stream_first_arrivals", "segment_id:s ts:t", "SELECT DISTINCT segment_id, ts FROM readings")(
    lambda c: _streamed(c, live.first_arrivals(c.readings_stream()).select("segment_id", "ts"), "first-arrivals"))
query("stream_slot_means", "segment_id:s slot:t readings:i speed_kmh:d flow_vph:d", """
SELECT segment_id, ts AS slot, count(*) AS readings, avg(speed_kmh) AS speed_kmh, avg(flow_vph) AS flow_vph FROM readings
WHERE ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM readings) - INTERVAL 15 MINUTE GROUP BY ALL""")(
    lambda c: _streamed(c, live.slot_means(c.readings_stream(), c.cfg), "slot-means"))
query("stream_trailing_quality", "segment_id:s until:t readings:i quality:d", """
SELECT segment_id, until, count(*) AS readings, avg(CASE WHEN speed_kmh >= 0 AND sensor_quality >= 0.5 THEN 1 ELSE 0 END) AS quality FROM (
  SELECT *, ts + INTERVAL 6 HOUR * k AS until FROM readings, (SELECT unnest(range(1, 13)) AS k)) WHERE until <= (SELECT max(ts) FROM readings) - INTERVAL 15 MINUTE GROUP BY ALL""")(
    lambda c: _streamed(c, live.trailing_quality(c.readings_stream(), c.cfg), "trailing-quality"))


def _sanitised_stream(c):
    live.enable_state(c.spark)
    return _streamed(c, live.sanitised(c.readings_stream(), c.segments, c.cfg), "sanitised")


query("stream_sanitised", "segment_id:s ts:t ingest_seq:i speed_kmh:d flow_vph:d congestion_index:d valid:b late:i", """
SELECT p.segment_id, p.ts, d.ingest_seq, p.speed_kmh, p.flow_vph, p.congestion_index, p.valid, 0 AS late FROM panel p JOIN dedup d ON d.segment_id = p.segment_id AND d.ts = p.ts
WHERE p.ts <= (SELECT max(ts) FROM readings) - INTERVAL 15 MINUTE""")(_sanitised_stream)


def _events_stream(c):
    source = fresh_path(c.spark, "flagged")
    c.components.filter("anomalous").select("segment_id", "ts", "score").write.parquet(source)
    flagged = c.spark.readStream.schema("segment_id string, ts timestamp, score double").option("maxFilesPerTrigger", 1000).parquet(source)
    return _streamed(c, live.ongoing_events(flagged, c.cfg), "ongoing")


query("stream_events", "segment_id:s start:t until:t slots:i peak_score:d", """
SELECT segment_id, start, "end" + INTERVAL 6 HOUR AS until, slots, peak_score FROM evs
WHERE "end" + INTERVAL 6 HOUR <= (SELECT max(ts) FROM components WHERE anomalous) - INTERVAL 15 MINUTE""", runs=_RUNS, evs=_EVENTS)(_events_stream)


def _scored_stream(c):
    path, checkpoint = fresh_path(c.spark, "scored"), fresh_path(c.spark, "scored-checkpoint")
    closed = live.slot_means(c.readings_stream(), c.cfg).withColumnRenamed("slot", "ts")
    live.score_batches(live.with_baseline(closed, c.segments, c.baseline, c.context), path, checkpoint).awaitTermination()
    return c.spark.read.parquet(path)


query("stream_scores", "segment_id:s ts:t drop:d net_shift:d local_drop:d", """
SELECT *, coalesce(drop - net_shift, 0) AS local_drop FROM sdrop LEFT JOIN (SELECT ts, greatest(median(drop), 0) AS net_shift FROM sdrop GROUP BY ts HAVING count(drop) > 0) USING (ts)""", sdrop="""
SELECT m.segment_id, m.ts, b.sr_med - m.speed_kmh / s.free_flow_speed_kmh AS drop FROM (
  SELECT segment_id, ts, avg(speed_kmh) AS speed_kmh FROM readings WHERE ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM readings) - INTERVAL 15 MINUTE GROUP BY ALL) m
JOIN segments s USING (segment_id) LEFT JOIN context c ON c.ts = m.ts
LEFT JOIN baseline b ON b.segment_id = m.segment_id AND b.hour = hour(m.ts) AND b.daytype = CASE WHEN isodow(m.ts) >= 6 OR c.holiday_flag > 0 THEN 1 ELSE 0 END""")(_scored_stream)
