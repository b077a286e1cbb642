"""Queries over detection, diagnosis and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import state_of
from ..operators import detect, diagnose, spread
from .registry import query

query("day_type", "segment_id:s ts:t daytype:i", "SELECT segment_id, ts, daytype FROM ratios")(
    lambda c: detect.with_daytype(c.panel, c.context))
query("label_mask", "segment_id:s ts:t", "SELECT segment_id, ts FROM inc_mask")(lambda c: c.incident_mask)
query("baseline", "segment_id:s hour:i daytype:i sr_med:d sr_mad:d fr_med:d fr_mad:d", "SELECT * FROM baseline")(
    lambda c: detect.baseline(c.up_to(c.ratios, c.cfg.train_end), c.labelled))
query("local_drop", "segment_id:s ts:t drop:d net_shift:d z_speed:d z_flow:d local_drop:d neighbor_max_drop:d",
      "SELECT segment_id, ts, drop, net_shift, z_speed, z_flow, local_drop, neighbor_max_drop FROM components")(
    lambda c: detect.components(c.ratios, c.baseline, c.edges))
query("score_variants", "segment_id:s ts:t z_composite:d local:d drop_epicentre:d",
      "SELECT segment_id, ts, z_composite, local_drop AS local, drop_epicentre FROM components")(
    lambda c: c.components.select("segment_id", "ts", detect.score("z_composite").alias("z_composite"), detect.score("drop").alias("local"),
                                  detect.score("drop_epicentre").alias("drop_epicentre")))

_SCORED = """
SELECT c.*, i.ts IS NOT NULL AS label FROM components c ANTI JOIN rw_slots w ON w.segment_id = c.segment_id AND w.ts = c.ts
LEFT JOIN inc_mask i ON i.segment_id = c.segment_id AND i.ts = c.ts WHERE c.ts <= TIMESTAMP '2024-01-24 18:00:00'"""
_LONG = """
SELECT 'z_composite' AS variant, round(z_composite, 9) AS v, label FROM scored UNION ALL SELECT 'drop', round(local_drop, 9), label FROM scored
UNION ALL SELECT 'drop_epicentre', round(drop_epicentre, 9), label FROM scored"""
_CUTS = """
SELECT DISTINCT variant, round(q, 9) AS threshold FROM (SELECT variant, unnest(quantile_cont(v, list_transform(range(300),
  lambda i: 0.95::DOUBLE + i * (0.99995::DOUBLE - 0.95::DOUBLE) / 299))) AS q FROM long_scores GROUP BY variant)"""
_SWEEP = """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM (
SELECT variant, threshold, count(*) FILTER (v >= threshold AND label) AS tp, count(*) FILTER (v >= threshold AND NOT label) AS fp,
  count(*) FILTER (v < threshold AND label) AS fn FROM cuts JOIN long_scores USING (variant) GROUP BY ALL))"""
_sweep_views = {"scored": _SCORED, "long_scores": _LONG, "cuts": _CUTS, "sweep": _SWEEP}

query("threshold_sweep", "variant:s threshold:d tp:i fp:i fn:i precision:d recall:d f1:d", "SELECT * FROM sweep", **_sweep_views)(lambda c: c.sweep)
query("detector_calibration", "variant:s threshold:d f1:d chosen:b", """
SELECT variant, threshold, f1, row_number() OVER (ORDER BY f1 DESC, CASE variant WHEN 'z_composite' THEN 1 WHEN 'drop' THEN 2 ELSE 3 END) = 1 AS chosen
FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f1 DESC, threshold) AS rn FROM sweep) WHERE rn = 1""", **_sweep_views)(
    lambda c: detect.best_thresholds(c.sweep))
query("traffic_state", "segment_id:s ts:t state:s", "SELECT segment_id, ts, state FROM components")(
    lambda c: c.ratios.select("segment_id", "ts", state_of("speed_ratio").alias("state")))

_CONF = "(1 / (1 + exp(-(score - 0.2::DOUBLE) / (0.25::DOUBLE * 0.2::DOUBLE)))) * quality"
_LABEL = f"CASE WHEN {_CONF} >= 0.8 THEN 'HIGH' WHEN {_CONF} >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"
query("snapshot_state", "segment_id:s ts:t speed_ratio:d state:s score:d anomalous:b confidence:d", f"""
SELECT segment_id, ts, speed_ratio, state, score, anomalous, {_CONF} AS confidence FROM components""")(
    lambda c: detect.scored(detect.components(c.ratios, c.baseline, c.edges), c.cfg)
    .withColumn("confidence", detect.confidence(F.col("score"), c.cfg.threshold, F.col("quality"))))
query("confidence_labels", "confidence_label:s anomalous:b cells:i", f"""
SELECT {_LABEL} AS confidence_label, anomalous, count(*) AS cells FROM components GROUP BY ALL""")(
    lambda c: c.components.groupBy(detect.confidence_label(
        detect.confidence(F.col("score"), c.cfg.threshold, F.col("quality"))).alias("confidence_label"), "anomalous").agg(F.count("*").alias("cells")))

_RUNS = """
SELECT *, min(ts) OVER (PARTITION BY segment_id, anomalous, island) AS run_start FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ts) - row_number() OVER (PARTITION BY segment_id, anomalous ORDER BY ts) AS island,
    lag(speed_ratio) OVER (PARTITION BY segment_id ORDER BY ts) - speed_ratio AS step FROM components)"""
_EVENTS = """
SELECT segment_id, run_start AS start, max(ts) AS "end", count(*) AS slots, max(score) AS peak_score FROM runs WHERE anomalous GROUP BY ALL"""
query("events", "segment_id:s start:t end:t slots:i peak_score:d", 'SELECT * FROM evs', runs=_RUNS, evs=_EVENTS)(
    lambda c: detect.events(c.components))
query("recent_events", "segment_id:s start:t end:t slots:i duration_min:i peak_score:d ongoing:b", """
SELECT segment_id, min(ts) AS start, max(ts) AS "end", count(*) AS slots, count(*) * 360 AS duration_min, max(score) AS peak_score,
  max(ts) = TIMESTAMP '2024-01-26 12:00:00' AS ongoing
FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ts) - row_number() OVER (PARTITION BY segment_id, anomalous ORDER BY ts) AS g
  FROM components WHERE ts BETWEEN TIMESTAMP '2024-01-26 12:00:00' - INTERVAL 30 HOUR AND TIMESTAMP '2024-01-26 12:00:00')
WHERE anomalous GROUP BY segment_id, g""")(
    lambda c: detect.recent_events(c.dated_components, "2024-01-26 12:00:00", c.cfg))
query("run_onset", "segment_id:s ts:t run_start:t onset_step:d duration_min:i", """
SELECT r.segment_id, r.ts, r.run_start, coalesce(o.step, 0) AS onset_step, date_diff('minute', r.run_start, r.ts) + 360 AS duration_min
FROM runs r JOIN runs o ON o.segment_id = r.segment_id AND o.ts = r.run_start WHERE r.anomalous""", runs=_RUNS)(
    lambda c: c.diagnosed.filter("anomalous"))
query("active_roadworks", "segment_id:s ts:t works:i work_type:s", "SELECT * FROM rw_active")(lambda c: c.roadworks_active)

# ---- recurring bottlenecks
_BN = {"bn_days": "SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM ratios WHERE ts <= TIMESTAMP '2024-01-24 18:00:00'",
       "bn_whole": """
SELECT segment_id, nullif(quantile_cont(flow_ratio, 0.99) FILTER (hour IN (6, 18)), NULL) / nullif(quantile_cont(flow_ratio, 0.99)
  FILTER (hour NOT IN (6, 18)), 0) AS amplification, avg(congestion_index) FILTER (hour IN (6, 18)) AS peak_mean_congestion
FROM clean_train GROUP BY 1""",
       "bn_daily": """
SELECT segment_id, CAST(ts AS DATE) AS day, quantile_cont(flow_ratio, 0.95) FILTER (hour IN (6, 18))
  / nullif(quantile_cont(flow_ratio, 0.95) FILTER (hour NOT IN (6, 18)), 0) AS ratio FROM clean_train GROUP BY ALL""",
       "bn_med": "SELECT day, median(ratio) AS m FROM bn_daily GROUP BY day",
       "bn_mad": "SELECT day, 1.4826::DOUBLE * median(abs(ratio - m)) AS s FROM bn_daily JOIN bn_med USING (day) GROUP BY day",
       "bn_low": """
SELECT segment_id, count(*) FILTER ((ratio - m) / nullif(s, 0) <= -1.5) AS low_days
FROM bn_daily JOIN bn_med USING (day) JOIN bn_mad USING (day) GROUP BY 1""",
       "bn_m": "SELECT median(amplification) AS m FROM bn_whole",
       "bn_s": "SELECT 1.4826::DOUBLE * median(abs(amplification - m)) AS s FROM bn_whole, bn_m",
       "bottlenecks": """
SELECT w.segment_id, amplification, (amplification - m) / nullif(s, 0) AS robust_z, coalesce(low_days, 0)::DOUBLE / n AS recurrence,
  peak_mean_congestion, coalesce((amplification - m) / nullif(s, 0) <= -2.5, false) AS detected
FROM bn_whole w LEFT JOIN bn_low USING (segment_id), bn_m, bn_s, bn_days"""}
query("recurring_bottlenecks", "segment_id:s amplification:d robust_z:d recurrence:d peak_mean_congestion:d detected:b",
      "SELECT * FROM bottlenecks", **_BN)(
    lambda c: detect.bottlenecks(c.up_to(c.ratios, c.cfg.train_end), c.labelled, c.cfg))

# ---- causes
_DIAG = """
SELECT d.*, CASE WHEN works IS NOT NULL THEN 'ROADWORK_EFFECT' WHEN anomalous AND onset_step >= 0.1 THEN 'TRANSIENT_INCIDENT'
  WHEN anomalous THEN 'UNKNOWN' WHEN local_drop >= 0.2::DOUBLE AND neighbor_max_drop > local_drop THEN 'PROPAGATED_CONGESTION'
  WHEN congested AND recurring AND hour(ts) IN (6, 18) THEN 'RECURRING_BOTTLENECK'
  WHEN congested AND (coalesce(net_shift >= 0.03::DOUBLE, false) OR rain_intensity >= 0.3::DOUBLE OR event_level > 0) THEN 'WEATHER_EVENT_EFFECT'
  ELSE 'NORMAL_VARIATION' END AS cause
FROM (SELECT r.*, CASE WHEN r.anomalous THEN coalesce(o.step, 0) ELSE 0 END AS onset_step,
    CASE WHEN r.anomalous THEN date_diff('minute', r.run_start, r.ts) + 360 ELSE 0 END AS duration_min,
    w.works, x.rain_intensity, x.event_level, coalesce(r.speed_ratio < 0.85::DOUBLE, false) AS congested,
    coalesce(b.detected, false) AS recurring
  FROM runs r LEFT JOIN runs o ON r.anomalous AND o.segment_id = r.segment_id AND o.ts = r.run_start
  LEFT JOIN rw_active w ON w.segment_id = r.segment_id AND w.ts = r.ts LEFT JOIN context x ON x.ts = r.ts
  LEFT JOIN bottlenecks b ON b.segment_id = r.segment_id) d"""
DIAG_VIEWS = {**_BN, "runs": _RUNS, "diagnosed": _DIAG}
query("cause", "segment_id:s ts:t cause:s onset_step:d duration_min:i source_neighbor:s", """
SELECT d.segment_id, d.ts, cause, onset_step, duration_min, CASE WHEN cause = 'PROPAGATED_CONGESTION' THEN (
  SELECT max(e.neighbor_id) FROM edges e JOIN components n ON n.segment_id = e.neighbor_id
  WHERE e.segment_id = d.segment_id AND n.ts = d.ts AND n.local_drop = d.neighbor_max_drop) END AS source_neighbor FROM diagnosed d""", **DIAG_VIEWS)(
    lambda c: diagnose.diagnoses(c.components, c.roadworks_active, c.bottlenecks, c.context, c.edges, c.cfg))
query("detections", "segment_id:s ts:t state:s score:d cause:s confidence:d confidence_label:s", f"""
SELECT segment_id, ts, state, score, cause, {_CONF} AS confidence, {_LABEL} AS confidence_label FROM diagnosed
WHERE anomalous OR state <> 'NORMAL'""", **DIAG_VIEWS)(lambda c: diagnose.detections(c.diagnosed))
_EVIDENCE = """
SELECT segment_id, ts, metric, value, baseline, threshold, unit, CASE WHEN baseline <> 0 THEN (value - baseline) / abs(baseline) * 100 END AS diff_pct
FROM (SELECT *, queue_length_veh - lag(queue_length_veh, 3) OVER (PARTITION BY segment_id ORDER BY ts) AS qc FROM diagnosed) d,
LATERAL (VALUES ('speed', speed_kmh, sr_med * free_flow_speed_kmh, NULL, 'km/h'), ('local_speed_ratio_drop', local_drop, NULL, 0.2, ''),
  ('flow', flow_vph, fr_med * capacity_vph, NULL, 'veh/h'), ('congestion_index', congestion_index, 1 - sr_med, NULL, ''),
  ('queue_change_15min', qc, NULL, NULL, 'veh'), ('largest_neighbor_drop', neighbor_max_drop, NULL, NULL, ''),
  ('network_wide_shift', net_shift, NULL, 0.03, ''), ('rain_intensity', rain_intensity, NULL, 0.3, ''),
  ('event_present', CASE WHEN event_level > 0 THEN 1 ELSE 0 END, NULL, NULL, ''),
  ('roadwork_active', CASE WHEN works IS NOT NULL THEN 1 ELSE 0 END, NULL, NULL, ''), ('data_quality', quality, NULL, NULL, ''))
  v(metric, value, baseline, threshold, unit)"""
query("evidence", "segment_id:s ts:t metric:s value:d baseline:d threshold:d unit:s diff_pct:d", "SELECT * FROM ev_rows",
      ev_rows=_EVIDENCE, **DIAG_VIEWS)(lambda c: diagnose.evidence(c.diagnosed, c.cfg))
SNAP_SQL = f"""
SELECT c.segment_id, c.ts, state, speed_kmh, flow_vph, occupancy_pct,
  CASE WHEN speed_ratio > 0 THEN length_km / s.free_flow_speed_kmh * 60 / speed_ratio END AS travel_time_min,
  length_km / s.free_flow_speed_kmh * 60 AS free_flow_time_min, delay_min, queue_length_veh AS queue_veh, congestion_index,
  flow_ratio AS capacity_utilization, speed_ratio, score AS anomaly_score, anomalous, {_CONF} AS confidence, quality AS data_quality,
  road_class, signal_id IS NOT NULL AS signalized, coalesce(detected, false) AS recurring_bottleneck_detected
FROM components c JOIN segments s USING (segment_id) LEFT JOIN bottlenecks b USING (segment_id)"""
SNAP_VIEWS = {**_BN, "snaps": SNAP_SQL}
query("snapshot_rows", "segment_id:s ts:t state:s speed_kmh:d flow_vph:d occupancy_pct:d travel_time_min:d free_flow_time_min:d delay_min:d "
      "queue_veh:d congestion_index:d capacity_utilization:d speed_ratio:d anomaly_score:d anomalous:b confidence:d data_quality:d "
      "road_class:s signalized:b recurring_bottleneck_detected:b", "SELECT * FROM snaps", **SNAP_VIEWS)(lambda c: c.snapshots)
query("snapshot_summary", "ts:t n_normal:i n_moderate:i n_heavy:i n_critical:i n_no_data:i n_anomalous:i mean_quality:d mean_speed_ratio:d", """
SELECT ts, count(*) FILTER (state = 'NORMAL') AS n_normal, count(*) FILTER (state = 'MODERATE') AS n_moderate,
  count(*) FILTER (state = 'HEAVY') AS n_heavy, count(*) FILTER (state = 'CRITICAL') AS n_critical,
  count(*) FILTER (state = 'NO_DATA') AS n_no_data, count(*) FILTER (anomalous) AS n_anomalous, avg(data_quality) AS mean_quality,
  avg(speed_ratio) AS mean_speed_ratio FROM snaps GROUP BY ts""", **SNAP_VIEWS)(lambda c: diagnose.snapshot_summary(c.snapshots))
query("segment_detail", "segment_id:s ts:t state:s cause:s lanes:i road_class:s n_evidence:i first_metric:s speed_diff_pct:d", """
SELECT segment_id, d.ts, state, cause, lanes, road_class, 11 AS n_evidence, 'congestion_index' AS first_metric,
  (SELECT diff_pct FROM ev_rows e WHERE e.segment_id = d.segment_id AND e.ts = d.ts AND e.metric = 'speed') AS speed_diff_pct
FROM diagnosed d JOIN segments USING (segment_id)""", ev_rows=_EVIDENCE, **DIAG_VIEWS)(
    lambda c: diagnose.segment_details(c.segments, c.snapshots, c.diagnosed, diagnose.evidence(c.diagnosed, c.cfg))
    .withColumns({"n_evidence": F.size("evidence"), "first_metric": F.col("evidence")[0]["metric"],
                  "speed_diff_pct": F.filter("evidence", lambda e: e["metric"] == "speed")[0]["diff_pct"]}))

# ---- incident types
_SHAPES = """
SELECT incident_id, i.segment_id, incident_type, avg(drop) AS mean_drop,
  avg(flow_ratio / CASE WHEN fr_med IS NULL THEN NULL ELSE greatest(fr_med, 0.001::DOUBLE) END - 1) AS mean_flow_change
FROM inc_slots i JOIN components c ON c.segment_id = i.segment_id AND c.ts = i.ts
WHERE start_time < TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL HAVING count(drop) > 0 AND count(flow_ratio / fr_med) > 0"""
_CENTRES = """
SELECT incident_type, avg(mean_drop) AS c_drop, avg(mean_flow_change) AS c_flow, count(*) AS incidents,
  (SELECT greatest(stddev_pop(mean_drop), 0.001::DOUBLE) FROM shapes) AS sd_drop,
  (SELECT greatest(stddev_pop(mean_flow_change), 0.001::DOUBLE) FROM shapes) AS sd_flow FROM shapes GROUP BY 1"""
query("type_centroids", "incident_type:s c_drop:d c_flow:d incidents:i sd_drop:d sd_flow:d", "SELECT * FROM centres",
      shapes=_SHAPES, centres=_CENTRES)(lambda c: c.centroids)
TYPE_SQL = """
SELECT {id}, mean_drop, CASE WHEN total > 0 THEN w / total ELSE 0 END AS likelihood,
  CASE WHEN coalesce(w / nullif(total, 0), 0) < 0.5 THEN 'UNKNOWN' ELSE incident_type END AS likely_type,
  CASE WHEN w / nullif(total, 0) >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS type_confidence
FROM (SELECT *, sum(w) OVER (PARTITION BY {id}) AS total, row_number() OVER (PARTITION BY {id} ORDER BY w DESC, t DESC) AS rn FROM (
  SELECT {ids}, h.mean_drop, t.incident_type, t.incident_type AS t, exp(-0.5::DOUBLE * (pow((h.mean_drop - c_drop) / sd_drop, 2) + pow((h.mean_flow_change - c_flow) / sd_flow, 2))) AS w
  FROM {shapes} h, centres t)) WHERE rn = 1"""
query("type_likelihood", "incident_id:s mean_drop:d likelihood:d likely_type:s type_confidence:s",
      TYPE_SQL.format(id="incident_id", ids="h.incident_id", shapes="shapes"), shapes=_SHAPES, centres=_CENTRES)(
    lambda c: diagnose.type_likelihood(c.shapes, c.centroids))
query("run_type_likelihood", "segment_id:s ts:t mean_drop:d likelihood:d likely_type:s type_confidence:s",
      TYPE_SQL.format(id="segment_id, ts", ids="h.segment_id, h.ts", shapes="run_shapes"), shapes=_SHAPES, centres=_CENTRES, runs=_RUNS,
      run_shapes="""
SELECT * FROM (SELECT segment_id, ts, avg(drop) OVER w AS mean_drop,
  avg(flow_ratio / CASE WHEN fr_med IS NULL THEN NULL ELSE greatest(fr_med, 0.001::DOUBLE) END - 1) OVER w AS mean_flow_change
FROM runs WHERE anomalous WINDOW w AS (PARTITION BY segment_id, run_start ORDER BY ts ROWS UNBOUNDED PRECEDING))
WHERE mean_drop IS NOT NULL AND mean_flow_change IS NOT NULL""")(
    lambda c: diagnose.type_likelihood(diagnose.run_shapes(c.components), c.centroids))
query("scenario_list", "incident_id:s segment_id:s demo_time:t direct_candidate:b state:s cause:s score:d", """
SELECT i.incident_id, i.segment_id, i.demo_time, EXISTS (SELECT 1 FROM candidates k WHERE k.target_segment = i.segment_id) AS direct_candidate,
  state, cause, score
FROM (SELECT *, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(ceil(epoch_us(start_time) / 21600000000) * 21600 AS BIGINT) AS demo_time FROM incidents) i
LEFT JOIN diagnosed d ON d.segment_id = i.segment_id AND d.ts = i.demo_time""", **DIAG_VIEWS)(
    lambda c: diagnose.scenarios(c.incidents, c.candidates, c.diagnosed, c.cfg))
query("evaluation_windows", "scenario_id:s flagged_cells:i has_event:b peak_segment:s peak_score:d", """
SELECT work_id AS scenario_id, count(c.segment_id) AS flagged_cells, count(c.segment_id) > 0 AS has_event,
  arg_max(c.segment_id, (c.score, c.segment_id)) AS peak_segment, max(c.score) AS peak_score
FROM roadworks w JOIN slots t ON t.ts >= w.start_time AND t.ts <= w.end_time LEFT JOIN components c ON c.ts = t.ts AND c.anomalous GROUP BY 1""")(
    lambda c: detect.event_windows(c.roadworks.select(F.col("work_id").alias("scenario_id"), F.col("start_time").alias("window_start"),
                                                      F.col("end_time").alias("window_end")), c.components, c.cfg))

# ---- propagation
_SAMPLES = """
SELECT incident_id, reached_id, hop, direction, avg(n.drop) / any_value(source_drop) AS ratio,
  CASE WHEN hop = 1 AND max(n.drop) > 0.05 THEN min(place) FILTER (n.drop > 0.5::DOUBLE * top) * 360 END AS lag_min
FROM (SELECT i.incident_id, i.segment_id, i.ts, u.source_drop, row_number() OVER (PARTITION BY i.incident_id ORDER BY i.ts) - 1 AS place
      FROM inc_slots i JOIN usable u USING (incident_id)) i
JOIN reach r ON r.segment_id = i.segment_id
JOIN (SELECT *, drop AS d0 FROM components) n ON n.segment_id = r.reached_id AND n.ts = i.ts
JOIN (SELECT i.incident_id AS ii, r.reached_id AS rr, max(n.drop) AS top FROM inc_slots i JOIN reach r USING (segment_id)
      JOIN components n ON n.segment_id = r.reached_id AND n.ts = i.ts GROUP BY ALL) m ON m.ii = i.incident_id AND m.rr = r.reached_id
GROUP BY 1, 2, 3, 4"""
_USABLE = """
SELECT incident_id, avg(drop) AS source_drop FROM inc_slots i JOIN components c USING (segment_id, ts)
WHERE start_time < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1 HAVING avg(drop) > 0.1 AND count(*) >= 2"""
_CALIB = """
SELECT direction, hop, decay, greatest(coalesce(lag, 360), 360) AS lag_min_per_hop, samples FROM (
  SELECT direction, hop, median(ratio) AS decay, count(*) AS samples FROM samples GROUP BY ALL)
LEFT JOIN (SELECT direction, median(lag_min) AS lag FROM samples GROUP BY 1) USING (direction)"""
CALIB_VIEWS = {"usable": _USABLE, "samples": _SAMPLES, "calibration": _CALIB}
query("propagation_calibration", "direction:s hop:i decay:d lag_min_per_hop:d samples:i", "SELECT * FROM calibration", **CALIB_VIEWS)(
    lambda c: spread.calibrate(spread.calibration_samples(c.in_train(c.incidents), c.components, c.reach, c.cfg), c.cfg))
_RISK = """CASE WHEN risk >= 0.5 THEN 'HIGH' WHEN risk >= 0.25 THEN 'MEDIUM' WHEN risk >= 0.1 THEN 'LOW' ELSE 'MINIMAL' END"""
PROPAGATION = f"""
SELECT *, {_RISK} AS impact_level FROM (SELECT *, least(1, predicted_drop / 0.4::DOUBLE) AS risk FROM (
SELECT c.segment_id, c.ts, r.reached_id, r.hop, r.direction, lag_min_per_hop * r.hop AS eta_min,
  greatest(c.local_drop, 0) * decay * (0.75::DOUBLE + 0.5::DOUBLE * least(greatest(coalesce(n.flow_ratio, 0.5), 0), 1)) AS predicted_drop
FROM components c JOIN reach r USING (segment_id) JOIN calibration k ON k.direction = r.direction AND k.hop = r.hop
JOIN components n ON n.segment_id = r.reached_id AND n.ts = c.ts WHERE c.anomalous))"""
query("propagation", "segment_id:s ts:t reached_id:s hop:i direction:s predicted_drop:d risk:d impact_level:s eta_min:d", PROPAGATION, **CALIB_VIEWS)(
    lambda c: spread.propagate(c.components.filter("anomalous").select("segment_id", "ts", F.col("local_drop").alias("source_drop")),
                               c.components, c.reach, c.calibration))
_MOVED = """
SELECT p.*, d.day, p.ts + INTERVAL 1 DAY * d.day AS there
FROM remaining p, (VALUES (-3), (-2), (-1), (1), (2), (3)) d(day)"""
query("propagation_evaluation", "tp:i fp:i fn:i hit_rate:d recall:d control_n:i control_hits:i control_rate:d", """
SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS hit_rate, tp::DOUBLE / nullif(tp + fn, 0) AS recall, control_hits::DOUBLE / nullif(control_n, 0) AS control_rate
FROM (SELECT count(*) FILTER (pred AND actual) AS tp, count(*) FILTER (pred AND NOT actual) AS fp, count(*) FILTER (NOT pred AND actual) AS fn
      FROM outcome), (SELECT count(*) AS control_n, count(*) FILTER (d > 0.05) AS control_hits FROM (
  SELECT incident_id, reached_id, day, avg(drop) AS d FROM moved m LEFT JOIN (SELECT segment_id, ts, drop FROM components) n
    ON n.segment_id = m.reached_id AND n.ts = m.there GROUP BY ALL
  HAVING min(there) >= TIMESTAMP '2024-01-25 00:00:00' AND max(there) <= TIMESTAMP '2024-01-30 18:00:00'))""",
      issued="""
SELECT * FROM (SELECT *, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(ceil(epoch_us(start_time) / 21600000000) * 21600 AS BIGINT) AS t_issue
FROM inc_val) WHERE t_issue <= TIMESTAMP '2024-01-30 18:00:00'""",
      remaining="""
SELECT i.incident_id, i.segment_id, i.t_issue, r.reached_id, r.hop, r.direction, t.ts
FROM issued i JOIN slots t ON t.ts > i.t_issue AND t.ts <= i.end_time JOIN reach r USING (segment_id)""",
      outcome="""
SELECT p.incident_id, p.reached_id, coalesce(avg(n.drop) > 0.05, false) AS actual,
  coalesce(least(1, greatest(coalesce(any_value(src.drop), 0), 0) * any_value(decay)
    * (0.75::DOUBLE + 0.5::DOUBLE * least(greatest(coalesce(any_value(ld.flow_ratio), 0), 0), 1)) / 0.4::DOUBLE) >= 0.1, false) AS pred
FROM remaining p JOIN components n ON n.segment_id = p.reached_id AND n.ts = p.ts
JOIN components src ON src.segment_id = p.segment_id AND src.ts = p.t_issue
JOIN components ld ON ld.segment_id = p.reached_id AND ld.ts = p.t_issue
JOIN calibration k ON k.direction = p.direction AND k.hop = p.hop GROUP BY ALL""", moved=_MOVED, **CALIB_VIEWS)(
    lambda c: spread.evaluate(c.in_validation(c.incidents), c.components, c.reach, c.calibration, c.cfg))
