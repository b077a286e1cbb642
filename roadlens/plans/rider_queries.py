"""Queries over rider-facing assessment and over planning candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose, forecast, rider, routes, whatif
from .corridor_queries import GEO
from .detect_queries import _CENTRES, CALIB_VIEWS, PROPAGATION, _EVIDENCE, _SHAPES, DIAG_VIEWS, SNAP_VIEWS, TYPE_SQL
from .forecast_queries import _OUTLOOK, FC
from .grid_queries import WAY, WAYS
from .registry import query

# ---- route assessment
_LVL = "CASE WHEN {0} IS NULL THEN 'no_data' WHEN {0} >= 0.85::DOUBLE THEN 'free_flow' WHEN {0} >= 0.70::DOUBLE THEN 'moderate' WHEN {0} >= 0.50::DOUBLE THEN 'heavy' WHEN {0} >= 0 THEN 'severe' ELSE 'no_data' END"
_DELAY = "sum(ds_m / 1000 / greatest(distance_km / greatest(duration_min, 0.1::DOUBLE) * 60, 5) * 60 * (1 / CASE WHEN {0} IS NULL OR {0} >= 0.85::DOUBLE THEN 1 ELSE greatest({0}, 0.25::DOUBLE) END - 1))"
RIDE = {**GEO,
    "smp0": """
SELECT route_id, i AS idx, total_m / (n - 1) * i AS at_m, CASE WHEN i = 0 OR i = n - 1 THEN total_m / (n - 1) / 2 ELSE total_m / (n - 1) END AS ds_m
FROM (SELECT *, CAST(greatest(ceil(total_m / 120) + 1, 2) AS BIGINT) AS n FROM totals), LATERAL (SELECT unnest(range(n)) AS i)""",
    "smp": """
SELECT route_id, idx, at_m, ds_m, p.lat + f * (p.lat2 - p.lat) AS lat, p.lon + f * (p.lon2 - p.lon) AS lon, p.x + f * (p.x2 - p.x) AS px, p.y + f * (p.y2 - p.y) AS py
FROM (SELECT s.*, p, least((at_m - p.start_m) / p.piece_m, 1) AS f FROM smp0 s
  JOIN pieces p ON p.route_id = s.route_id AND at_m >= p.start_m AND (at_m < p.end_m OR p.is_last))""",
    "smp_pairs": """
SELECT *, row_number() OVER (PARTITION BY route_id, idx ORDER BY round(dist, 6), segment_id) = 1 AS nearest FROM (
  SELECT route_id, idx, segment_id, sqrt(pow(px - ax - f * (bx - ax), 2) + pow(py - ay - f * (by_ - ay), 2)) AS dist FROM (
    SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / greatest(pow(bx - ax, 2) + pow(by_ - ay, 2), 1e-9), 0), 1) AS f FROM smp, lines))
WHERE dist <= 1500""",
    "rr": """
SELECT segment_id, ts, coalesce(speed_ratio, 1) AS ratio_now, CASE WHEN speed_ratio IS NULL THEN 1 ELSE least(greatest(speed_ratio
  + coalesce(lag(speed_ratio, 3) OVER w - lag(speed_ratio, 4) OVER w, 0), 0), 1) END AS ratio_later FROM ratios WINDOW w AS (PARTITION BY segment_id ORDER BY ts)""",
    "smp_ratio": """
SELECT route_id, idx, ts, coalesce(min(ratio_now) FILTER (dist <= 750), max(ratio_now) FILTER (nearest)) AS ratio_now,
  coalesce(min(ratio_later) FILTER (dist <= 750), max(ratio_later) FILTER (nearest)) AS ratio_later
FROM smp_pairs JOIN rr USING (segment_id) GROUP BY ALL""",
    "smp_state": f"""
SELECT s.*, t.ts, r.ratio_now, r.ratio_later, total_m / 1000 AS distance_km, total_m / 1000 / 30 * 60 AS duration_min, {_LVL.format('r.ratio_now')} AS level
FROM smp s CROSS JOIN slots t JOIN totals USING (route_id) LEFT JOIN smp_ratio r ON r.route_id = s.route_id AND r.idx = s.idx AND r.ts = t.ts""",
    "assessed": f"""
SELECT *, CASE WHEN severe_m >= 300 THEN 'severe' WHEN severe_m + heavy_m >= 300 THEN 'heavy' WHEN severe_m + heavy_m + moderate_m >= 300 THEN 'moderate' ELSE 'free_flow' END AS traffic_level
FROM (SELECT route_id, ts, sum(CASE WHEN level = 'severe' THEN ds_m ELSE 0 END) AS severe_m, sum(CASE WHEN level = 'heavy' THEN ds_m ELSE 0 END) AS heavy_m,
  sum(CASE WHEN level = 'moderate' THEN ds_m ELSE 0 END) AS moderate_m, {_DELAY.format('ratio_now')} AS delay_min, {_DELAY.format('ratio_later')} AS delay_later_min,
  sum(CASE WHEN lat BETWEEN (SELECT min(lat) - 0.009::DOUBLE FROM nodes) AND (SELECT max(lat) + 0.009::DOUBLE FROM nodes)
            AND lon BETWEEN (SELECT min(lon) - 0.009::DOUBLE FROM nodes) AND (SELECT max(lon) + 0.009::DOUBLE FROM nodes) THEN ds_m ELSE 0 END) / greatest(sum(ds_m), 1) * 100 AS coverage_pct,
  any_value(distance_km) AS distance_km, any_value(duration_min) AS duration_min FROM smp_state GROUP BY ALL)""",
    "worst": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, ts ORDER BY rk DESC, -coalesce(round(ratio_now, 9), 1) DESC, idx DESC) AS rn FROM (
  SELECT *, CASE level WHEN 'severe' THEN 3 WHEN 'heavy' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END AS rk FROM smp_state)) WHERE rn = 1 AND rk >= 2""",
    "opts": """
SELECT *, row_number() OVER (PARTITION BY trip_id, ts ORDER BY round(expected + 0.1::DOUBLE * distance_km, 9), is_default DESC, route_id) AS ranking,
  round_even(eta, 0) AS eta_min, round_even(delay_min, 0) AS delay_rounded, round_even(worsening, 0) AS worsening_min, round_even(coverage_pct, 0) AS coverage_rounded
FROM (SELECT *, eta + 0.5::DOUBLE * worsening AS expected FROM (SELECT *, duration_min + delay_min AS eta, greatest(0, delay_later_min - delay_min) AS worsening
  FROM assessed JOIN (SELECT DISTINCT route_id, trip_id, is_default FROM route_nodes) USING (route_id)))"""}
query("route_samples", "route_id:s idx:i at_m:d ds_m:d lat:d lon:d", "SELECT * FROM smp", **RIDE)(lambda c: routes.samples(c.route_vertices))
query("sample_segments", "route_id:s idx:i segment_id:s nearest:b dist_m:d", "SELECT *, dist AS dist_m FROM smp_pairs WHERE nearest OR dist <= 750", **RIDE)(
    lambda c: rider.sample_segments(routes.samples(c.route_vertices), c.lines))
query("sample_ratios", "route_id:s idx:i ts:t ratio_now:d ratio_later:d", "SELECT * FROM smp_ratio", **RIDE)(
    lambda c: rider.sample_ratios(c.sample_segments, c.rider_ratios, ["ratio_now", "ratio_later"]))
query("route_assessment", "route_id:s ts:t traffic_level:s delay_min:d delay_later_min:d coverage_pct:d severe_m:d heavy_m:d moderate_m:d", "SELECT * FROM assessed", **RIDE)(
    lambda c: rider.assess(c.sample_states, c.route_facts, c.nodes))
query("worst_points", "route_id:s ts:t worst_lat:d worst_lon:d worst_level:s", "SELECT route_id, ts, lat AS worst_lat, lon AS worst_lon, level AS worst_level FROM worst", **RIDE)(
    lambda c: c.assessed.filter(F.col("worst_level").isNotNull()))
query("level_runs", "route_id:s ts:t level:s length_m:d first_idx:i last_idx:i", """
SELECT route_id, ts, level, round_even(sum(ds_m), 0) AS length_m, min(idx) AS first_idx, max(idx) AS last_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY route_id, ts ORDER BY idx) - row_number() OVER (PARTITION BY route_id, ts, level ORDER BY idx) AS g FROM smp_state)
GROUP BY route_id, ts, level, g""", **RIDE)(lambda c: rider.level_runs(c.sample_states))
query("route_ranking", "trip_id:s route_id:s ts:t ranking:i recommended:b label:s eta_min:d delay_rounded:d worsening_min:d", """
SELECT *, ranking = 1 AS recommended, CASE ranking WHEN 1 THEN 'Recommended route' ELSE 'Alternative' END AS label FROM opts""", **RIDE)(lambda c: c.route_options)
query("diversions", "trip_id:s ts:t current_id:s alternative_id:s current_eta_min:d alternative_eta_min:d saving_min:d alternative_level:s confidence:s reason:s", """
SELECT d.trip_id, d.ts, d.route_id AS current_id, a.route_id AS alternative_id, d.eta_min AS current_eta_min, a.eta_min AS alternative_eta_min,
  round_even(d.expected - a.expected, 0) AS saving_min, a.traffic_level AS alternative_level,
  CASE WHEN d.expected - a.expected >= 5 AND least(d.coverage_rounded, a.coverage_rounded) >= 40 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN d.traffic_level IN ('severe', 'heavy') THEN d.traffic_level ELSE 'worsening' END AS reason
FROM opts d JOIN opts a ON a.trip_id = d.trip_id AND a.ts = d.ts AND d.is_default AND NOT a.is_default
WHERE (d.traffic_level IN ('heavy', 'severe') OR d.worsening_min >= 3) AND d.expected - a.expected >= 2""", **RIDE)(lambda c: rider.diversions(c.route_options))
query("route_alerts", "trip_id:s ts:t route_id:s type:s severity:s lat:d lon:d", """
SELECT o.trip_id, o.ts, o.route_id, 'congestion' AS type, traffic_level AS severity, w.lat, w.lon FROM opts o LEFT JOIN worst w ON w.route_id = o.route_id AND w.ts = o.ts
WHERE is_default AND traffic_level IN ('heavy', 'severe')
UNION ALL SELECT trip_id, ts, route_id, 'forecast', 'warning', NULL, NULL FROM opts WHERE is_default AND worsening_min >= 2""", **RIDE)(
    lambda c: rider.route_alerts(c.route_options))
query("area_alerts", "segment_id:s ts:t severity:s lat:d lon:d confidence:s", """
SELECT c.segment_id, ts, CASE WHEN state = 'CRITICAL' THEN 'severe' ELSE 'heavy' END AS severity, (a_lat + b_lat) / 2 AS lat, (a_lon + b_lon) / 2 AS lon,
  CASE WHEN cf >= 0.8 THEN 'high' WHEN cf >= 0.5 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, (1 / (1 + exp(-(score - 0.2::DOUBLE) / (0.25::DOUBLE * 0.2::DOUBLE)))) * quality AS cf FROM components) c JOIN lines USING (segment_id)
WHERE anomalous AND state IN ('HEAVY', 'CRITICAL')""", **GEO)(lambda c: rider.area_alerts(c.diagnosed, c.lines))
query("traffic_zones", "segment_id:s ts:t traffic_level:s speed_kmh:d congestion:d", """
SELECT segment_id, ts, CASE state WHEN 'MODERATE' THEN 'moderate' WHEN 'HEAVY' THEN 'heavy' ELSE 'severe' END AS traffic_level, round_even(speed_kmh, 1) AS speed_kmh,
  round_even(congestion_index, 3) AS congestion FROM snaps WHERE state IN ('MODERATE', 'HEAVY', 'CRITICAL')""", **SNAP_VIEWS)(lambda c: rider.traffic_zones(c.snapshots))
query("traffic_zone_counts", "ts:t free_flow:i moderate:i heavy:i severe:i no_data:i", """
SELECT ts, count(*) FILTER (state = 'NORMAL') AS free_flow, count(*) FILTER (state = 'MODERATE') AS moderate, count(*) FILTER (state = 'HEAVY') AS heavy,
  count(*) FILTER (state = 'CRITICAL') AS severe, count(*) FILTER (state = 'NO_DATA') AS no_data FROM components GROUP BY ts""")(lambda c: rider.zone_counts(c.snapshots))
query("congested_segment_lookup", "point_id:s ts:t segment_id:s near:b", """
SELECT point_id, ts, segment_id, dist <= 750 AS near FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id, ts ORDER BY dist > 750, round(CASE WHEN dist > 750 THEN dist ELSE speed_ratio END, 9), segment_id) AS rn FROM (
    SELECT point_id, segment_id, sqrt(pow(px - ax - f * (bx - ax), 2) + pow(py - ay - f * (by_ - ay), 2)) AS dist FROM (
      SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / greatest(pow(bx - ax, 2) + pow(by_ - ay, 2), 1e-9), 0), 1) AS f
      FROM (SELECT poi_id AS point_id, (lon - 78.45::DOUBLE) * (111320::DOUBLE * cos(radians(17.4::DOUBLE))) AS px, (lat - 17.4::DOUBLE) * 110540::DOUBLE AS py FROM pois), lines))
  JOIN (SELECT segment_id, ts, speed_ratio FROM ratios WHERE speed_ratio < 0.85::DOUBLE) USING (segment_id) WHERE dist <= 1500) WHERE rn = 1""", **GEO)(
    lambda c: rider.find_segments(c.pois.withColumnRenamed("poi_id", "point_id"), c.lines, c.components))
query("nearest_places", "point_id:i category:s poi_id:s distance_m:d place:i", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, category ORDER BY round(distance_m, 6), poi_id) AS place FROM (
  SELECT n.node_id AS point_id, p.category, p.poi_id, 2 * 6371000::DOUBLE * asin(sqrt(pow(sin((radians(p.lat) - radians(n.lat)) / 2), 2)
    + cos(radians(n.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - n.lon) / 2), 2))) AS distance_m FROM nodes n, pois p) WHERE distance_m <= 1200) WHERE place <= 12""")(
    lambda c: rider.nearest_places(c.nodes.withColumnRenamed("node_id", "point_id"), c.pois, 1200.0))
_RUN_TYPES = TYPE_SQL.format(id="segment_id, ts", ids="h.segment_id, h.ts", shapes="run_shapes")
_RUN_SHAPES = """
SELECT * FROM (SELECT segment_id, ts, avg(drop) OVER w AS mean_drop,
  avg(flow_ratio / CASE WHEN fr_med IS NULL THEN NULL ELSE greatest(fr_med, 0.001::DOUBLE) END - 1) OVER w AS mean_flow_change
FROM runs WHERE anomalous WINDOW w AS (PARTITION BY segment_id, run_start ORDER BY ts ROWS UNBOUNDED PRECEDING))
WHERE mean_drop IS NOT NULL AND mean_flow_change IS NOT NULL"""
query("traffic_explanation", "segment_id:s ts:t traffic_level:s status:s cause_label:s certainty:s type:s signals:s trend:s forecast_note:s may_spread:b", """
SELECT segment_id, ts, traffic_level, status, CASE WHEN normal THEN NULL ELSE CASE cause WHEN 'ROADWORK_EFFECT' THEN 'Roadwork' WHEN 'TRANSIENT_INCIDENT' THEN 'Traffic disruption'
    WHEN 'PROPAGATED_CONGESTION' THEN 'Congestion spreading from nearby roads' WHEN 'RECURRING_BOTTLENECK' THEN 'Recurring congestion'
    WHEN 'WEATHER_EVENT_EFFECT' THEN CASE WHEN rain_intensity >= 0.3::DOUBLE OR event_level > 0 THEN 'Weather or event slowdown' ELSE 'City-wide slowdown' END ELSE 'Cause unclear' END END AS cause_label,
  CASE WHEN normal THEN NULL ELSE CASE cause WHEN 'ROADWORK_EFFECT' THEN 'reported' WHEN 'TRANSIENT_INCIDENT' THEN CASE WHEN cf >= 0.8 THEN 'likely' ELSE 'possible' END
    WHEN 'PROPAGATED_CONGESTION' THEN 'likely' WHEN 'RECURRING_BOTTLENECK' THEN 'likely' WHEN 'WEATHER_EVENT_EFFECT' THEN 'possible' ELSE 'unknown' END END AS certainty,
  CASE WHEN NOT normal AND cause = 'TRANSIENT_INCIDENT' THEN CASE WHEN type_confidence = 'MEDIUM' AND likely_type <> 'UNKNOWN' THEN likely_type ELSE 'undetermined' END END AS type,
  CASE WHEN normal THEN '' ELSE concat_ws(',', CASE WHEN speed_diff <= -10 THEN 'speed_drop' END, CASE WHEN onset_step >= 0.1 THEN 'sudden_onset' END, CASE WHEN queue_change >= 5 THEN 'queue_growth' END,
    CASE WHEN rise >= 0.15 THEN 'congestion_change' END, 'roadwork', CASE WHEN rain_intensity >= 0.3::DOUBLE THEN 'weather' END, CASE WHEN cause = 'RECURRING_BOTTLENECK' THEN 'recurring' END) END AS signals,
  trend, CASE WHEN normal OR trend IS NULL THEN NULL WHEN trend = 'worsening' AND neighbor_max_drop >= 0.05::DOUBLE THEN 'building, nearby roads slow too' WHEN trend = 'worsening' THEN 'building'
    WHEN trend = 'easing' THEN 'easing' ELSE 'about the same' END AS forecast_note,
  NOT normal AND neighbor_max_drop >= 0.05::DOUBLE AND coalesce(trend <> 'easing', false) AS may_spread
FROM (SELECT d.*, o.trend, state IN ('NORMAL', 'NO_DATA') AS normal, (1 / (1 + exp(-(score - 0.2::DOUBLE) / (0.25::DOUBLE * 0.2::DOUBLE)))) * quality AS cf, t.likely_type, t.type_confidence,
    CASE state WHEN 'NORMAL' THEN 'free_flow' WHEN 'MODERATE' THEN 'moderate' WHEN 'HEAVY' THEN 'heavy' WHEN 'CRITICAL' THEN 'severe' ELSE 'no_data' END AS traffic_level,
    CASE WHEN state IN ('NORMAL', 'NO_DATA') THEN 'normal' WHEN cause = 'TRANSIENT_INCIDENT' THEN 'disruption_detected' ELSE 'congestion' END AS status,
    e.speed_diff, e.queue_change, e.rise
  FROM diagnosed d LEFT JOIN run_types t ON t.segment_id = d.segment_id AND t.ts = d.ts
  LEFT JOIN (SELECT segment_id, ts, any_value(trend) AS trend FROM outlook GROUP BY ALL) o ON o.segment_id = d.segment_id AND o.ts = d.ts
  LEFT JOIN (SELECT segment_id, ts, max(diff_pct) FILTER (metric = 'speed') AS speed_diff, max(value) FILTER (metric = 'queue_change_15min') AS queue_change,
      max(value - baseline) FILTER (metric = 'congestion_index') AS rise FROM ev_rows GROUP BY ALL) e ON e.segment_id = d.segment_id AND e.ts = d.ts)""",
      **DIAG_VIEWS, **FC, outlook=_OUTLOOK, ev_rows=_EVIDENCE, run_types=_RUN_TYPES, run_shapes=_RUN_SHAPES, shapes=_SHAPES, centres=_CENTRES)(
    lambda c: rider.explanations(c.diagnosed, diagnose.type_likelihood(diagnose.run_shapes(c.components), c.centroids)
                                 .select("segment_id", "ts", "likely_type", "type_confidence"), diagnose.evidence(c.diagnosed, c.cfg),
                                 forecast.outlook(c.daily_forecast, c.segments)))

# ---- link times and comparison
_LINK_TIME = """free_h * (1 + 0.15::DOUBLE * pow(greatest(flow, 0) / {cap}, 4)) + CASE WHEN cycle > 0
  THEN 0.5::DOUBLE * cycle * (1 - green) * (1 - green) / (1 - least(greatest(flow, 0) / {cap}, 0.95::DOUBLE) * green) / 3600 ELSE 0 END"""
LINKS = {"links": f"""
SELECT *, {_LINK_TIME.format(cap='cap')} AS time_h, flow / cap AS vc FROM (
SELECT p.segment_id, p.ts, coalesce(p.flow_vph, 0) AS flow, s.length_km, s.length_km / s.free_flow_speed_kmh AS free_h, coalesce(g.cycle_s, 0) AS cycle,
  coalesce(g.green_ratio, 1) AS green, s.capacity_vph * CASE WHEN hour(p.ts) IN (6, 18) THEN s.peak_capacity_factor ELSE 1 END AS cap
FROM panel p JOIN segments s USING (segment_id) LEFT JOIN signals g ON g.signal_id = s.signal_id)""",
    "links_next": "SELECT * REPLACE (ts - INTERVAL 6 HOUR AS ts) FROM links"}
_KPI = """
SELECT ts, sum(flow * time_h) AS travel_time_veh_h, sum(flow * (time_h - free_h)) AS delay_veh_h, sum(flow * length_km) / greatest(sum(flow * time_h), 1e-9) AS avg_speed_kmh,
  sum(flow * (1 - free_h / time_h)) / greatest(sum(flow), 1e-9) AS avg_congestion, count(*) FILTER (vc > 1) AS over_capacity_links,
  sum(CASE WHEN vc > 1 THEN flow ELSE 0 END) AS over_capacity_flow_vph FROM {} GROUP BY ts"""
query("link_states", "segment_id:s ts:t flow:d cap:d time_h:d vc:d vc_level:s", """
SELECT *, CASE WHEN vc IS NULL THEN 'no_data' WHEN vc < 0.6::DOUBLE THEN 'low' WHEN vc < 0.85::DOUBLE THEN 'medium' WHEN vc < 1 THEN 'high' ELSE 'over_capacity' END AS vc_level FROM links""", **LINKS)(
    lambda c: c.links.withColumn("vc_level", whatif.vc_level("vc")))
query("capacity_adjustment", "segment_id:s ts:t cap:d reduced:d extended:d", """
SELECT segment_id, ts, cap, cap * greatest(m, 0.1::DOUBLE) AS reduced, CASE WHEN cap * greatest(m, 0.1::DOUBLE) - 400 > 0 THEN cap * greatest(m, 0.1::DOUBLE) - 400 END AS extended
FROM (SELECT *, 1 - vc AS m FROM links)""", **LINKS)(
    lambda c: c.links.withColumn("m", 1 - F.col("vc")).withColumns({"reduced": whatif.adjusted_capacity("cap", "m"),
                                                                    "extended": whatif.adjusted_capacity("cap", "m", F.lit(-400.0))}))
query("network_kpis", "ts:t travel_time_veh_h:d delay_veh_h:d avg_speed_kmh:d avg_congestion:d over_capacity_links:d over_capacity_flow_vph:d", _KPI.format("links"), **LINKS)(
    lambda c: whatif.network_kpis(c.links))


def _next(c):
    """The state one slot later, as the outcome compared with each slot."""
    return c.links.withColumn("ts", F.col("ts") - F.expr("INTERVAL 6 HOURS"))


query("kpi_changes", "ts:t kpi:s before:d after:d change:d pct_change:d", """
SELECT a.ts, a.kpi, a.v AS before, b.v AS after, b.v - a.v AS change, CASE WHEN a.v <> 0 THEN (b.v - a.v) / a.v * 100 END AS pct_change
FROM (UNPIVOT kb ON travel_time_veh_h, delay_veh_h, avg_speed_kmh, avg_congestion, over_capacity_links, over_capacity_flow_vph INTO NAME kpi VALUE v) a
JOIN (UNPIVOT ka ON travel_time_veh_h, delay_veh_h, avg_speed_kmh, avg_congestion, over_capacity_links, over_capacity_flow_vph INTO NAME kpi VALUE v) b
  ON a.ts = b.ts AND a.kpi = b.kpi""", kb=_KPI.format("links").replace("count(*) FILTER (vc > 1)", "CAST(count(*) FILTER (vc > 1) AS DOUBLE)"),
      ka=_KPI.format("links_next").replace("count(*) FILTER (vc > 1)", "CAST(count(*) FILTER (vc > 1) AS DOUBLE)"), **LINKS)(
    lambda c: whatif.kpi_changes(c.links, _next(c)))
_CHG = """
SELECT *, CASE WHEN relative < -0.01::DOUBLE THEN 'improved' WHEN relative > 0.01::DOUBLE THEN 'worsened' ELSE 'same' END AS moved FROM (
SELECT a.ts, a.segment_id, (b.time_h - a.time_h) * 60 AS delta_min, (b.time_h - a.time_h) / a.time_h AS relative
FROM links a JOIN links_next b USING (ts, segment_id))"""
query("link_changes", "ts:t segment_id:s delta_min:d relative:d moved:s", "SELECT * FROM chg", chg=_CHG, **LINKS)(lambda c: whatif.link_changes(c.links, _next(c)))
query("change_counts", "ts:t improved:i worsened:i links:i", """
SELECT ts, count(*) FILTER (moved = 'improved') AS improved, count(*) FILTER (moved = 'worsened') AS worsened, count(*) AS links FROM chg GROUP BY ts""", chg=_CHG, **LINKS)(
    lambda c: whatif.change_counts(whatif.link_changes(c.links, _next(c))))
query("largest_changes", "ts:t moved:s place:i segment_id:s delta_min:d", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts, moved ORDER BY round(CASE WHEN moved = 'worsened' THEN -delta_min ELSE delta_min END, 9), segment_id) AS place
FROM chg WHERE moved <> 'same') WHERE place <= 5""", chg=_CHG, **LINKS)(lambda c: whatif.largest_changes(whatif.link_changes(c.links, _next(c))))

# ---- candidates
_POOL = """
SELECT s.segment_id, s.segment_id AS target_segment, 0 AS hop, 'direct' AS relation, k.* EXCLUDE (target_segment) FROM segments s JOIN candidates k ON k.target_segment = s.segment_id
UNION ALL SELECT r.segment_id, r.reached_id, r.hop, r.direction || ' neighbor (hop ' || CAST(r.hop AS VARCHAR) || ')', k.* EXCLUDE (target_segment)
FROM reach r JOIN candidates k ON k.target_segment = r.reached_id WHERE r.hop <= 2"""
_FEAS = """
SELECT k.*, s.segment_id IS NOT NULL AS target_exists, intervention_type <> 'signal_retiming' OR s.signal_id IS NOT NULL AS signal_ok,
  intervention_type <> 'turn_lane' OR coalesce(x.exits, 0) >= 2 AS exits_ok, CASE WHEN feasibility_band <> 'high' THEN 'penalised in ranking' END AS band_note
FROM candidates k LEFT JOIN segments s ON s.segment_id = k.target_segment
LEFT JOIN (SELECT source_node, count(*) AS exits FROM segments GROUP BY 1) x ON x.source_node = s.target_node"""
_TRIED = """
SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY segment_id ORDER BY hop, cost_index, candidate_id) AS tried FROM pool p
  JOIN (SELECT candidate_id AS ok_id FROM feas WHERE target_exists AND signal_ok AND exits_ok) ON ok_id = candidate_id) WHERE tried <= 6"""
PLAN = {**LINKS, **DIAG_VIEWS, "pool": _POOL, "feas": _FEAS, "tried": _TRIED,
    "lk": "SELECT *, flow * (time_h - free_h) AS delay FROM links",
    "cs": """
SELECT d.segment_id, d.ts, d.state, d.anomalous, CASE WHEN d.anomalous THEN 1 - CASE d.state WHEN 'CRITICAL' THEN 0.5::DOUBLE WHEN 'HEAVY' THEN 0.33::DOUBLE WHEN 'MODERATE' THEN 0.2::DOUBLE ELSE 0 END
  ELSE 1 END AS keep FROM diagnosed d WHERE d.anomalous OR d.state <> 'NORMAL'""",
    "cs_now": f"""
SELECT c.*, l.flow * ({_LINK_TIME.format(cap='(l.cap * greatest(c.keep, 0.1::DOUBLE))')} - l.free_h) AS own, l.delay AS own_free FROM cs c JOIN lk l USING (segment_id, ts)""",
    "cs_net": """
SELECT c.*, n.d - own_free + own AS before_net, own + coalesce(b.d, 0) AS before_local FROM cs_now c JOIN (SELECT ts, sum(delay) AS d FROM lk GROUP BY ts) n USING (ts)
LEFT JOIN (SELECT e.segment_id, l.ts, sum(l.delay) AS d FROM (SELECT DISTINCT segment_id, neighbor_id FROM edges) e JOIN lk l ON l.segment_id = e.neighbor_id GROUP BY ALL) b
  ON b.segment_id = c.segment_id AND b.ts = c.ts""",
    "tries": f"""
SELECT *, flow * (t_now - t_new) AS saved FROM (
SELECT *, {_LINK_TIME.format(cap='cap_now')} AS t_now, {_LINK_TIME.format(cap='(cap_now + capacity_delta_vph)')} AS t_new FROM (
  SELECT c.segment_id, c.ts, c.state, c.anomalous, c.before_net, c.before_local, t.candidate_id, t.target_segment, t.hop, t.relation, t.intervention_type, t.capacity_delta_vph, t.cost_index,
    t.feasibility_band, l.flow, l.free_h, l.cycle, l.green, l.cap * CASE WHEN t.hop = 0 THEN greatest(c.keep, 0.1::DOUBLE) ELSE 1 END AS cap_now
  FROM cs_net c JOIN tried t USING (segment_id) JOIN lk l ON l.segment_id = t.target_segment AND l.ts = c.ts))""",
    "evals": """
SELECT *, 2 * network_pct + 0.1::DOUBLE * local_pct - 0.1::DOUBLE * worsened_pct - cost - penalty AS score FROM (
SELECT *, CASE WHEN before_net <> 0 THEN saved / before_net * 100 ELSE 0 END AS network_pct,
  CASE WHEN before_local > 0 THEN CASE WHEN hop <= 1 THEN saved ELSE 0 END / before_local * 100 ELSE 0 END AS local_pct,
  CASE WHEN t_new > 1.01::DOUBLE * t_now THEN 100::DOUBLE / (SELECT count(*) FROM segments) ELSE 0 END AS worsened_pct,
  cost_index / (SELECT max(cost_index) FROM candidates) AS cost, CASE feasibility_band WHEN 'high' THEN 0 WHEN 'medium' THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS penalty FROM tries)""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, ts ORDER BY round(score, 9) DESC, candidate_id) AS rank FROM evals) WHERE rank = 1"}
query("candidate_listing", "candidate_id:s target_segment:s intervention_type:s capacity_delta_vph:i cost_index:i feasibility_band:s", "SELECT * FROM candidates ORDER BY candidate_id")(
    lambda c: c.candidates.orderBy("candidate_id"))
query("segment_listing", "segment_id:s source_node:i target_node:i road_class:s lanes:i free_flow_speed_kmh:d capacity_vph:d length_km:d grade_pct:d importance:d signal_id:s",
      "SELECT * FROM segments")(lambda c: diagnose.listing(c.segments))
query("od_demand", "origin_node:i destination_node:i base_demand_vph:d", "SELECT * FROM od_demand")(lambda c: c.od_demand)
query("candidate_pool", "segment_id:s candidate_id:s target_segment:s hop:i relation:s cost_index:i", "SELECT * FROM pool", pool=_POOL)(
    lambda c: whatif.candidate_pool(c.reach, c.segments, c.candidates))
query("candidate_feasibility", "candidate_id:s target_segment:s target_exists:b signal_ok:b exits_ok:b feasible:b band_note:s",
      "SELECT *, target_exists AND signal_ok AND exits_ok AS feasible FROM feas", feas=_FEAS)(lambda c: whatif.feasibility(c.candidates, c.segments))
query("candidate_evaluation", "segment_id:s ts:t candidate_id:s hop:i network_pct:d local_pct:d worsened_pct:d cost:d penalty:d score:d", "SELECT * FROM evals", **PLAN)(
    lambda c: whatif.evaluate_candidates(c.cases, c.links, c.edges, c.shortlist, c.candidates, c.n_segments))
_ALL_TRIED = "SELECT p.* FROM pool p JOIN (SELECT candidate_id AS ok_id FROM feas WHERE target_exists AND signal_ok AND exits_ok) ON ok_id = candidate_id"
query("candidate_ranking", "segment_id:s ts:t candidate_id:s relation:s score:d rank:i", """
SELECT *, row_number() OVER (PARTITION BY segment_id, ts ORDER BY round(score, 9) DESC, candidate_id) AS rank FROM evals""", **{**PLAN, "tried": _ALL_TRIED})(
    lambda c: whatif.ranked(c.evaluated_all))


def _dec(x: str, digits: int = 2) -> str:
    """Fixed decimals as text, as ``functions.columns.decimals`` writes them."""
    scale = 10 ** digits
    n = f"CAST(floor(abs({x}) * {scale} + 0.5001::DOUBLE) AS BIGINT)"
    return f"(CASE WHEN {x} < 0 AND {n} > 0 THEN '-' ELSE '' END || CAST({n} // {scale} AS VARCHAR) || '.' || lpad(CAST({n} % {scale} AS VARCHAR), {digits}, '0'))"


_ADVISED = f"""
SELECT segment_id, ts, kind, CASE WHEN kind = 'candidate' THEN candidate_id END AS candidate_id,
  ['LOW', 'MEDIUM', 'HIGH'][1 + greatest(base - CASE WHEN kind = 'candidate' AND hop > 0 THEN 1 ELSE 0 END - CASE WHEN kind = 'candidate' AND abs(saved) < 0.1::DOUBLE THEN 1 ELSE 0 END, 0)] AS confidence,
  CASE kind WHEN 'none' THEN 'Leave as is' WHEN 'candidate' THEN 'Try ' || replace(intervention_type, '_', ' ') || ' ' || candidate_id || ' at ' || target_segment ELSE 'Respond by operations' END AS headline,
  concat_ws('; ', CASE WHEN anomalous THEN 'anomaly score ' || {_dec('dscore')} || ' of at least 0.2 (' || cause || ')' END,
    CASE WHEN speed_ratio IS NOT NULL THEN 'state ' || state || ', speed ratio ' || {_dec('speed_ratio')} ELSE 'no current reading' END,
    CASE WHEN rising THEN 'more congestion ahead' WHEN NOT rising THEN 'no more congestion ahead' END, 'may spill over to ' || at_risk,
    CASE kind WHEN 'candidate' THEN 'best feasible candidate (' || relation || '), score ' || {_dec('cscore', 3)}
      WHEN 'operational' THEN CASE WHEN candidate_id IS NULL THEN 'no feasible candidate within reach' ELSE 'no candidate reduced the delay' END END) AS reasons,
  2 + CASE WHEN kind = 'candidate' AND hop > 0 THEN 1 ELSE 0 END + CASE WHEN kind = 'candidate' AND abs(saved) < 0.1::DOUBLE THEN 1 ELSE 0 END AS n_limitations
FROM (SELECT d.segment_id, d.ts, d.anomalous, d.state, d.cause, d.speed_ratio, d.score AS dscore, b.candidate_id, b.hop, b.saved, b.target_segment, b.intervention_type, b.relation, b.score AS cscore,
  round(s.p50 - s.now, 9) > 0.02::DOUBLE AS rising, r.at_risk,
  CASE WHEN d.state = 'NORMAL' AND NOT d.anomalous THEN 'none' WHEN b.network_pct > 0 AND b.local_pct > 0 THEN 'candidate' ELSE 'operational' END AS kind,
  CASE WHEN d.anomalous THEN CASE WHEN cf >= 0.8 THEN 2 WHEN cf >= 0.5 THEN 1 ELSE 0 END WHEN d.state <> 'NORMAL' THEN 1 ELSE 2 END AS base
  FROM (SELECT *, (1 / (1 + exp(-(score - 0.2::DOUBLE) / (0.25::DOUBLE * 0.2::DOUBLE)))) * quality AS cf FROM diagnosed) d LEFT JOIN best b ON b.segment_id = d.segment_id AND b.ts = d.ts
  LEFT JOIN seas s ON s.segment_id = d.segment_id AND s.ts = d.ts AND s.metric = 'congestion' AND s.horizon_min = 720
  LEFT JOIN (SELECT segment_id, ts, array_to_string(list_slice(list(reached_id ORDER BY -round(risk, 9), reached_id), 1, 4), ', ') AS at_risk
             FROM (SELECT DISTINCT segment_id, ts, reached_id, risk FROM propagated WHERE impact_level = 'HIGH') GROUP BY ALL) r ON r.segment_id = d.segment_id AND r.ts = d.ts)"""
query("recommendations", "segment_id:s ts:t kind:s candidate_id:s confidence:s headline:s reasons:s n_limitations:i", "SELECT * FROM advised",
      **PLAN, **FC, **CALIB_VIEWS, propagated=PROPAGATION, advised=_ADVISED)(
    lambda c: c.advice.withColumns({"reasons": F.concat_ws("; ", "reasons"), "n_limitations": F.size("limitations")}))

# ---- before and after a candidate, per case
_TIMES = lambda cap: _LINK_TIME.format(cap=cap)
_TOUCHED = f"""
SELECT *, {_TIMES('cap_before')} AS time_before, {_TIMES('cap_after')} AS time_after FROM (
  SELECT c.segment_id, c.ts, t.candidate_id, l.segment_id AS link_id, l.flow, l.length_km, l.free_h, l.cycle, l.green, l.cap AS cap_seen, l.time_h AS time_seen,
    l.cap * greatest(CASE WHEN l.segment_id = c.segment_id THEN c.keep ELSE 1 END, 0.1::DOUBLE) AS cap_before,
    l.cap * greatest(CASE WHEN l.segment_id = c.segment_id THEN c.keep ELSE 1 END, 0.1::DOUBLE) + CASE WHEN l.segment_id = t.target_segment THEN capacity_delta_vph ELSE 0 END AS cap_after
  FROM cs c JOIN tried t USING (segment_id) JOIN links l ON l.ts = c.ts AND l.segment_id IN (c.segment_id, t.target_segment))"""
_SUMS = {"time": "flow * {t}", "delay": "flow * ({t} - free_h)", "km": "flow * length_km", "lost": "flow * (1 - free_h / {t})", "flow": "flow",
         "over": "CASE WHEN flow > {c} THEN 1 ELSE 0 END", "over_flow": "CASE WHEN flow > {c} THEN flow ELSE 0 END"}
_FIGURES = {"travel_time_veh_h": "{0}time", "delay_veh_h": "{0}delay", "avg_speed_kmh": "{0}km / greatest({0}time, 1e-9)", "avg_congestion": "{0}lost / greatest({0}flow, 1e-9)",
            "over_capacity_links": "{0}over", "over_capacity_flow_vph": "{0}over_flow"}
_NETWORK = "SELECT ts, " + ", ".join(f"sum({e.format(t='time_h', c='cap')}) AS x_{n}" for n, e in _SUMS.items()) + " FROM links GROUP BY ts"
_CORRECTED = "SELECT segment_id, ts, candidate_id, " + ", ".join(
    f"any_value(x_{n}) + sum({e.format(t=f'time_{s}', c=f'cap_{s}')} - {e.format(t='time_seen', c='cap_seen')}) AS {s}_{n}" for s in ("before", "after") for n, e in _SUMS.items()
) + " FROM touched JOIN network USING (ts) GROUP BY ALL"
_SCENARIO = {**PLAN, "touched": _TOUCHED, "network": _NETWORK, "corrected": _CORRECTED}
query("scenario_kpi_changes", "segment_id:s ts:t candidate_id:s kpi:s before:d after:d change:d pct_change:d", """
SELECT *, after - before AS change, CASE WHEN before <> 0 THEN (after - before) / before * 100 END AS pct_change FROM (""" + " UNION ALL ".join(
    f"SELECT segment_id, ts, candidate_id, '{k}' AS kpi, {e.format('before_')} AS before, {e.format('after_')} AS after FROM corrected" for k, e in _FIGURES.items()) + ")", **_SCENARIO)(
    lambda c: whatif.scenario_kpis(c.touched, c.links))
_MOVED = """
SELECT *, (time_after - time_before) * 60 AS delta_min, flow / cap_before AS vc_before, flow / cap_after AS vc_after,
  CASE WHEN (time_after - time_before) / time_before < -0.01::DOUBLE THEN 'improved' WHEN (time_after - time_before) / time_before > 0.01::DOUBLE THEN 'worsened' ELSE 'same' END AS moved FROM touched"""
query("scenario_link_changes", "segment_id:s ts:t candidate_id:s link_id:s time_before:d time_after:d delta_min:d vc_before:d vc_after:d moved:s", "SELECT * FROM moved_links", moved_links=_MOVED, **_SCENARIO)(
    lambda c: whatif.scenario_links(c.touched))
query("scenario_change_counts", "segment_id:s ts:t candidate_id:s improved:i worsened:i links:i", """
SELECT segment_id, ts, candidate_id, count(*) FILTER (moved = 'improved') AS improved, count(*) FILTER (moved = 'worsened') AS worsened, (SELECT count(*) FROM segments) AS links
FROM moved_links GROUP BY ALL""", moved_links=_MOVED, **_SCENARIO)(lambda c: whatif.scenario_counts(whatif.scenario_links(c.touched), c.n_segments))

_LABELLED = """
SELECT d.*, CASE WHEN cf >= 0.8 THEN 'HIGH' WHEN cf >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label, CASE WHEN hour(ts) IN (6, 18) THEN 'peak' ELSE 'offpeak' END AS bucket
FROM (SELECT *, (1 / (1 + exp(-(score - 0.2::DOUBLE) / (0.25::DOUBLE * 0.2::DOUBLE)))) * quality AS cf FROM diagnosed WHERE anomalous OR state <> 'NORMAL') d"""
query("operational_options", "segment_id:s ts:t action:s detail:s detour_min:d direct_min:d", """
SELECT c.segment_id, c.ts, 'Prepare diversion' AS action, w.path AS detail, w.cost_hours * 60 AS detour_min, s.length_km / s.free_flow_speed_kmh * 60 AS direct_min
FROM called c JOIN way w ON w.blocked_id = c.segment_id AND w.bucket = c.bucket JOIN segments s ON s.segment_id = c.segment_id
WHERE c.state IN ('HEAVY', 'CRITICAL') OR c.anomalous
UNION ALL SELECT segment_id, ts, 'Investigate', 'cause ' || cause || ', confidence ' || confidence_label, NULL, NULL FROM called WHERE anomalous
UNION ALL SELECT segment_id, ts, 'Monitor', 're-evaluate on the next reading', NULL, NULL FROM called""", ways=WAYS, way=WAY, called=_LABELLED, **DIAG_VIEWS)(
    lambda c: whatif.operational_options(c.cases.withColumn("bucket", F.when(F.hour("ts").isin(*c.cfg.peak_hours), "peak").otherwise("offpeak")), c.detours, c.segments))
