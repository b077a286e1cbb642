"""Queries over routes, corridors and intervention comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import conf
from ..functions import geo
from ..operators import compare, corridor, routes
from .detect_queries import _BN
from .registry import query

# ---- geometry
GEO = {
    "spots": f"""
SELECT *, (lon - 78.45::DOUBLE) * (111320::DOUBLE * cos(radians(17.4::DOUBLE))) AS x, (lat - 17.4::DOUBLE) * 110540::DOUBLE AS y FROM route_nodes""",
    "pieces": """
SELECT *, coalesce(lag(end_m) OVER (PARTITION BY route_id ORDER BY seq), 0) AS start_m, row_number() OVER (PARTITION BY route_id ORDER BY seq DESC) = 1 AS is_last FROM (
  SELECT *, sum(piece_m) OVER (PARTITION BY route_id ORDER BY seq) AS end_m FROM (
    SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS piece_m FROM (
      SELECT route_id, seq, lat, lon, x, y, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(x) OVER w AS x2, lead(y) OVER w AS y2
      FROM spots WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE x2 IS NOT NULL))""",
    "totals": "SELECT route_id, max(end_m) AS total_m FROM pieces GROUP BY 1",
    "cuts": """
SELECT route_id, total_m, n, i AS idx, total_m / n * i AS from_m, total_m / n * (i + 1) AS to_m, total_m / n AS length_m FROM (
  SELECT *, CAST(least(greatest(round_even(total_m / 300, 0), 1), 300) AS BIGINT) AS n FROM totals WHERE total_m >= 20),
LATERAL (SELECT unnest(range(n)) AS i)""",
    "stretch": """
SELECT c.*, a.lat + fa * (a.lat2 - a.lat) AS start_lat, a.lon + fa * (a.lon2 - a.lon) AS start_lon, a.x + fa * (a.x2 - a.x) AS start_x,
  a.y + fa * (a.y2 - a.y) AS start_y, b.lat + fb * (b.lat2 - b.lat) AS end_lat, b.lon + fb * (b.lon2 - b.lon) AS end_lon,
  b.x + fb * (b.x2 - b.x) AS end_x, b.y + fb * (b.y2 - b.y) AS end_y
FROM (SELECT c.*, a, b, least((from_m - a.start_m) / a.piece_m, 1) AS fa, least((to_m - b.start_m) / b.piece_m, 1) AS fb FROM cuts c
  JOIN pieces a ON a.route_id = c.route_id AND from_m >= a.start_m AND (from_m < a.end_m OR a.is_last)
  JOIN pieces b ON b.route_id = c.route_id AND to_m >= b.start_m AND (to_m < b.end_m OR b.is_last)) c""",
    "lines": """
SELECT segment_id, (a.lon - 78.45::DOUBLE) * (111320::DOUBLE * cos(radians(17.4::DOUBLE))) AS ax, (a.lat - 17.4::DOUBLE) * 110540::DOUBLE AS ay,
  (b.lon - 78.45::DOUBLE) * (111320::DOUBLE * cos(radians(17.4::DOUBLE))) AS bx, (b.lat - 17.4::DOUBLE) * 110540::DOUBLE AS by_,
  a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon
FROM segments s JOIN nodes a ON a.node_id = s.source_node JOIN nodes b ON b.node_id = s.target_node""",
    "matched": """
SELECT s.*, m.segment_id AS grid_segment_id, m.dist AS match_distance_m FROM stretch s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY route_id, idx ORDER BY round(cos, 9) DESC, segment_id) AS rn FROM (
    SELECT *, min(dist) OVER (PARTITION BY route_id, idx) AS dmin FROM (
      SELECT route_id, idx, segment_id, sqrt(pow(px - ax - f * (bx - ax), 2) + pow(py - ay - f * (by_ - ay), 2)) AS dist,
        ((bx - ax) * tx + (by_ - ay) * ty) / (sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) * sqrt(tx * tx + ty * ty) + 1e-9) AS cos
      FROM (SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / greatest(pow(bx - ax, 2) + pow(by_ - ay, 2), 1e-9), 0), 1) AS f
            FROM (SELECT route_id, idx, (start_x + end_x) / 2 AS px, (start_y + end_y) / 2 AS py, end_x - start_x AS tx, end_y - start_y AS ty
                  FROM stretch), lines)))
  WHERE dmin <= 750 AND dist <= dmin + 40) m ON m.rn = 1 AND m.route_id = s.route_id AND m.idx = s.idx""",
}
query("metric_projection", "node_id:i x_m:d y_m:d", """
SELECT node_id, (lon - 78.45::DOUBLE) * (111320::DOUBLE * cos(radians(17.4::DOUBLE))) AS x_m, (lat - 17.4::DOUBLE) * 110540::DOUBLE AS y_m FROM nodes""")(
    lambda c: c.nodes.select("node_id", geo.project_x("lon").alias("x_m"), geo.project_y("lat").alias("y_m")))
query("polyline_lengths", "route_id:s seq:i start_m:d end_m:d", "SELECT route_id, seq, start_m, end_m FROM pieces", **GEO)(lambda c: c.pieces)
query("route_stretches", "route_id:s idx:i from_m:d to_m:d length_m:d start_lat:d start_lon:d end_lat:d end_lon:d", "SELECT * FROM stretch", **GEO)(
    lambda c: routes.stretches(c.route_vertices))
query("stretch_shapes", "route_id:s idx:i points:i mean_lat:d", """
SELECT s.route_id, s.idx, 2 + count(p.seq) AS points, (any_value(start_lat) + any_value(end_lat) + coalesce(sum(p.lat2), 0)) / (2 + count(p.seq)) AS mean_lat
FROM stretch s LEFT JOIN pieces p ON p.route_id = s.route_id AND p.end_m > s.from_m AND p.end_m < s.to_m GROUP BY ALL""", **GEO)(
    lambda c: routes.stretch_shapes(c.stretches, c.route_vertices).select(
        "route_id", "idx", F.size("coords").alias("points"),
        (F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["lat"]) / F.size("coords")).alias("mean_lat")))
query("stretch_matches", "route_id:s idx:i grid_segment_id:s match_distance_m:d", "SELECT * FROM matched", **GEO)(
    lambda c: routes.match(c.stretches, c.lines))
query("point_on_route", "route_id:s lat:d lon:d", """
SELECT t.route_id, p.lat + f * (lat2 - p.lat) AS lat, p.lon + f * (lon2 - p.lon) AS lon FROM (
  SELECT t.route_id, p, least((total_m / 3 - p.start_m) / p.piece_m, 1) AS f, p.lat2 AS lat2, p.lon2 AS lon2
  FROM totals t JOIN pieces p ON p.route_id = t.route_id AND total_m / 3 >= p.start_m AND (total_m / 3 < p.end_m OR p.is_last)) t""", **GEO)(
    lambda c: routes.locate(routes.lengths(c.pieces).withColumn("at_m", F.col("total_m") / 3), c.pieces, "at_m"))
_ROADS = """
SELECT route_id, seq AS road_no, CASE WHEN seq = 2 THEN 'Flyover ' || route_id ELSE 'Road ' || route_id || '-' || CAST(seq AS VARCHAR) END AS name, start_m, end_m
FROM pieces WHERE seq % 4 <> 3"""
_NAMED = """
SELECT m.*, r.name AS road_name FROM matched m LEFT JOIN (
  SELECT s.route_id, s.idx, r.name, row_number() OVER (PARTITION BY s.route_id, s.idx ORDER BY least(to_m, r.end_m) - greatest(from_m, r.start_m) DESC, road_no) AS rn
  FROM cuts s JOIN roads r ON r.route_id = s.route_id AND least(to_m, r.end_m) - greatest(from_m, r.start_m) > 0) r
ON r.rn = 1 AND r.route_id = m.route_id AND r.idx = m.idx"""
_JUNCTION = """
SELECT n.*, CASE WHEN n.route_id LIKE '%-H%' THEN (
    SELECT count(*) FROM spots j WHERE j.route_id = n.route_id AND j.seq BETWEEN 1 AND 3 AND sqrt(pow(j.x - k.mx, 2) + pow(j.y - k.my, 2)) <= n.length_m / 2)
  END AS junction_count
FROM named n JOIN (SELECT c.route_id, c.idx, p.x + f * (p.x2 - p.x) AS mx, p.y + f * (p.y2 - p.y) AS my FROM (
    SELECT c.route_id, c.idx, p, least(((from_m + to_m) / 2 - p.start_m) / p.piece_m, 1) AS f
    FROM cuts c JOIN pieces p ON p.route_id = c.route_id AND (from_m + to_m) / 2 >= p.start_m AND ((from_m + to_m) / 2 < p.end_m OR p.is_last)) c) k
ON k.route_id = n.route_id AND k.idx = n.idx"""
ROUTE = {**GEO, "roads": _ROADS, "named": _NAMED, "junctioned": _JUNCTION}
query("road_names", "route_id:s idx:i road_name:s", "SELECT * FROM named", **ROUTE)(
    lambda c: routes.road_names(c.stretches, c.roads))
query("junction_counts", "route_id:s idx:i junction_count:i", "SELECT * FROM junctioned", **ROUTE)(
    lambda c: routes.junction_counts(c.stretches, c.route_vertices, c.junctions, c.junction_sources))
query("corridor_requests", "trip_id:s route_id:s apart_km:d", """
SELECT trip_id, route_id, sqrt(pow((lat1 - lat2) * 110.5::DOUBLE, 2) + pow((lon1 - lon2) * 104::DOUBLE, 2)) AS apart_km FROM (
  SELECT trip_id, route_id, arg_min(lat, seq) AS lat1, arg_min(lon, seq) AS lon1, arg_max(lat, seq) AS lat2, arg_max(lon, seq) AS lon2 FROM route_nodes GROUP BY ALL)
WHERE least(lat1, lat2) >= 17.10 AND greatest(lat1, lat2) <= 17.70 AND least(lon1, lon2) >= 78.10 AND greatest(lon1, lon2) <= 78.80
  AND sqrt(pow((lat1 - lat2) * 110.5::DOUBLE, 2) + pow((lon1 - lon2) * 104::DOUBLE, 2)) BETWEEN 0.1 AND 40""")(
    lambda c: routes.requests_in_area(c._route_nodes.groupBy("trip_id", "route_id").agg(
        F.min_by("lat", "seq").alias("origin_lat"), F.min_by("lon", "seq").alias("origin_lon"), F.max_by("lat", "seq").alias("destination_lat"),
        F.max_by("lon", "seq").alias("destination_lon"))))

# ---- history and scores
STATS = {**_BN, "wk": """
SELECT p.*, s.free_flow_speed_kmh AS ff, hour(p.ts) IN (6, 18) AS pk FROM panel p JOIN segments s USING (segment_id)
WHERE isodow(p.ts) < 6 AND hour(p.ts) IN (0, 6, 12, 18) AND p.ts <= TIMESTAMP '2024-01-24 18:00:00'""",
    "means": """
SELECT segment_id, avg(flow_vph) FILTER (pk) AS peak_flow_vph, avg(speed_kmh) FILTER (pk) AS peak_speed_kmh,
  avg(speed_kmh) FILTER (NOT pk) AS off_speed, avg(delay_min) FILTER (pk) AS peak_delay,
  avg(CASE WHEN speed_kmh / ff < 0.7::DOUBLE THEN 1 ELSE 0 END) FILTER (pk AND speed_kmh IS NOT NULL) AS persistence FROM wk GROUP BY 1""",
    "dayno": """
SELECT day, row_number() OVER (ORDER BY day) AS lo, row_number() OVER (ORDER BY day DESC) AS hi, count(*) OVER () AS n
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM wk WHERE pk)""",
    "growths": """
SELECT segment_id, (avg(f) FILTER (hi <= 5) / avg(f) FILTER (lo <= 5) - 1) * 100 AS growth_pct FROM (
  SELECT segment_id, CAST(ts AS DATE) AS day, avg(flow_vph) AS f FROM wk WHERE pk GROUP BY ALL) JOIN dayno USING (day) WHERE n >= 10 GROUP BY 1""",
    "stats0": """
SELECT s.segment_id, s.length_km, s.lanes, s.road_class, s.free_flow_speed_kmh AS free_flow_kmh, s.capacity_vph, s.signal_id IS NOT NULL AS signalized,
  m.peak_flow_vph, m.peak_flow_vph / s.capacity_vph AS utilization, m.peak_speed_kmh,
  least(greatest(1 - m.peak_speed_kmh / m.off_speed, 0), 1) AS speed_reduction, m.peak_delay / s.length_km AS delay_min_per_km, persistence, growth_pct,
  coalesce(0.5::DOUBLE * cycle_s * (1 - green_ratio) * (1 - green_ratio) / (1 - least(m.peak_flow_vph / s.capacity_vph, 0.95::DOUBLE) * green_ratio), 0) AS signal_delay_s,
  CASE WHEN s.signal_id IS NOT NULL OR coalesce(x.exits, 0) >= 3 THEN 1 ELSE 0 END / s.length_km AS control_points_per_km,
  coalesce(i.incidents, 0) AS incidents, coalesce(i.incidents, 0) / s.length_km AS incidents_per_km, -b.robust_z AS ceiling_raw,
  (SELECT max(n) FROM dayno) AS history_days
FROM segments s LEFT JOIN means m USING (segment_id) LEFT JOIN growths USING (segment_id) LEFT JOIN signals g ON g.signal_id = s.signal_id
LEFT JOIN (SELECT source_node, count(*) AS exits FROM segments GROUP BY 1) x ON x.source_node = s.target_node
LEFT JOIN (SELECT segment_id, count(*) AS incidents FROM inc_train GROUP BY 1) i ON i.segment_id = s.segment_id
LEFT JOIN bottlenecks b ON b.segment_id = s.segment_id""",
    "seg_stats": """
SELECT *, control_points_per_km / (SELECT max(control_points_per_km) FROM stats0) * 50 + least(greatest(signal_delay_s / 60, 0), 1) * 50 AS junction_signal_raw FROM stats0""",
    "bounds": " UNION ALL ".join(f"SELECT '{m}' AS metric, quantile_cont({m}, 0.05) AS low, quantile_cont({m}, 0.95) AS high FROM seg_stats"
                                 for m in corridor.NORMALISED),
}


def _norm(x: str, metric: str | None = None) -> str:
    b = f"(SELECT {{}} FROM bounds WHERE metric = '{metric or x}')"
    low, high = b.format("low"), b.format("high")
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {high} > {low} THEN least(greatest(({x} - {low}) / ({high} - {low}), 0), 1) * 100 ELSE 0 END"


def _wmean(weights: dict) -> str:
    top = " + ".join(f"coalesce({k} * {w}::DOUBLE, 0)" for k, w in weights.items())
    used = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in weights.items())
    return f"CASE WHEN {used} > 0 THEN ({top}) / ({used}) END"


def _level(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NO_DATA' WHEN {x} >= 75 THEN 'CRITICAL' WHEN {x} >= 50 THEN 'HIGH' WHEN {x} >= 25 THEN 'MODERATE' ELSE 'LOW' END"


def _scores(source: str, ratio: str) -> str:
    c = {f"c_{k}": v for k, v in conf.CONGESTION_WEIGHTS.items()}
    b = {f"c_{k}": v for k, v in conf.BOTTLENECK_WEIGHTS.items()}
    return f"""
SELECT *, {_level('bottleneck')} AS level FROM (SELECT *, {_wmean(c)} AS congestion, {_wmean(b)} AS bottleneck FROM (
SELECT *, least(greatest(utilization, 0), 1) * 100 AS c_utilization, {_norm('speed_reduction')} AS c_speed_reduction, {_norm('delay_min_per_km')} AS c_delay,
  {_norm('junction_signal_raw')} AS c_junction_signal, persistence * 100 AS c_persistence, {_norm('ceiling_raw')} AS c_throughput_ceiling,
  {f'least(greatest((1 - {ratio}) / 0.5::DOUBLE, 0), 1) * 100' if ratio else 'CAST(NULL AS DOUBLE)'} AS c_current FROM {source}))"""


_STAT_COLUMNS = ("segment_id:s length_km:d lanes:i road_class:s free_flow_kmh:d capacity_vph:d signalized:b peak_flow_vph:d utilization:d peak_speed_kmh:d "
                 "speed_reduction:d delay_min_per_km:d persistence:d growth_pct:d signal_delay_s:d control_points_per_km:d incidents:i incidents_per_km:d "
                 "ceiling_raw:d history_days:i junction_signal_raw:d")
query("segment_history_stats", _STAT_COLUMNS, "SELECT * FROM seg_stats", **STATS)(
    lambda c: corridor.segment_stats(c.up_to(c.panel, c.cfg.train_end), c.segments, c.signals, c.in_train(c.incidents), c.bottlenecks, c.cfg))
query("robust_bounds", "metric:s low:d high:d", "SELECT * FROM bounds", **STATS)(lambda c: corridor.norms(c.segment_stats))
query("segment_scores", "segment_id:s congestion:d bottleneck:d level:s c_delay:d c_throughput_ceiling:d", "SELECT * FROM seg_scores",
      seg_scores=_scores("seg_stats", ""), **STATS)(lambda c: corridor.with_scores(c.segment_stats, c.norms))

_REC = {"rec0": """
SELECT j.*, t.* EXCLUDE (segment_id, length_km), t.length_km AS seg_length_km, c.speed_ratio, c.state FROM junctioned j
LEFT JOIN seg_stats t ON t.segment_id = j.grid_segment_id
LEFT JOIN components c ON c.segment_id = j.grid_segment_id AND c.ts = TIMESTAMP '2024-01-26 12:00:00'""",
        "rec1": _scores("rec0", "speed_ratio"),
        "records": """
SELECT * REPLACE (CASE WHEN grid_segment_id IS NULL THEN 'NO_DATA' ELSE level END AS level),
  CASE WHEN grid_segment_id IS NULL THEN 'NO_DATA' ELSE 'MATCHED' END AS data_status, round_even(CAST(signalized AS INT) * (length_m / 1000) / seg_length_km, 2) AS signal_count,
  round_even(peak_flow_vph, 0) AS traffic_volume, round_even(capacity_vph, 0) AS road_capacity, round_even(utilization * 100, 0) AS capacity_utilization_pct,
  round_even(peak_speed_kmh, 1) AS average_speed, round_even(length_m / 1000 / greatest(peak_speed_kmh, 1) * 60, 2) AS travel_time_min,
  round_even(delay_min_per_km * (length_m / 1000), 2) AS delay_min, round_even(persistence * 100, 0) AS historical_congestion_pct,
  round_even(growth_pct, 1) AS growth_rounded, round_even(signal_delay_s, 1) AS signal_delay_rounded, round_even(congestion, 0) AS congestion_index,
  round_even(bottleneck, 0) AS bottleneck_score FROM rec1"""}
RECORDS = {**STATS, **ROUTE, **_REC}
query("stretch_records", "route_id:s idx:i grid_segment_id:s data_status:s road_name:s junction_count:i signal_count:d traffic_volume:d road_capacity:d "
      "capacity_utilization_pct:d average_speed:d travel_time_min:d delay_min:d historical_congestion_pct:d incidents:i growth_rounded:d state:s "
      "congestion_index:d bottleneck_score:d level:s", "SELECT * FROM records", **RECORDS)(lambda c: c.stretch_records)
_ZONES = """
SELECT route_id, zone_no, min(idx) AS first_seed, max(idx) AS last_seed, count(*) AS seeds FROM (
  SELECT *, sum(opens) OVER (PARTITION BY route_id ORDER BY idx) AS zone_no FROM (
    SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR idx - lag(idx) OVER w > 2 OR missing <> lag(missing) OVER w THEN 1 ELSE 0 END AS opens FROM (
      SELECT route_id, idx, bottleneck_score, count(*) FILTER (bottleneck_score IS NULL) OVER (PARTITION BY route_id ORDER BY idx) AS missing FROM records)
    WHERE bottleneck_score >= 50 WINDOW w AS (PARTITION BY route_id ORDER BY idx))) GROUP BY ALL"""
query("corridor_zones", "route_id:s zone_no:i first_seed:i last_seed:i seeds:i", "SELECT * FROM zns", zns=_ZONES, **RECORDS)(lambda c: c.zones)
_FIRST = """
SELECT route_id, zone_no, a AS first_idx, e AS last_idx, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY route_id, zone_no ORDER BY gain DESC, a, e) AS rn FROM (
    SELECT z.route_id, z.zone_no, a.idx AS a, e.idx AS e, round(sum(m.bottleneck_score - 25), 6) AS gain
    FROM zns z JOIN records a ON a.route_id = z.route_id AND a.idx BETWEEN z.first_seed - 3 AND z.last_seed
    JOIN records e ON e.route_id = z.route_id AND e.idx BETWEEN a.idx AND z.last_seed + 3 AND e.to_m - a.from_m <= 2000.000001
    JOIN records m ON m.route_id = z.route_id AND m.idx BETWEEN a.idx AND e.idx GROUP BY 1, 2, 3, 4, z.first_seed, z.last_seed
    HAVING count(*) = count(m.bottleneck_score) AND count(*) FILTER (m.bottleneck_score >= 50 AND m.idx BETWEEN z.first_seed AND z.last_seed) > 0)) WHERE rn = 1"""
query("zone_first_extent", "route_id:s zone_no:i first_idx:i last_idx:i gain:d", "SELECT * FROM firsts", firsts=_FIRST,
      zns=_ZONES, **RECORDS)(lambda c: corridor.first_extents(c.stretch_records, c.zones))
query("corridor_candidates", "route_id:s cand_no:i first_idx:i last_idx:i seeds:i start_m:d end_m:d rank:i zone:s suitability:d screening:s")(
    lambda c: corridor.ranked_candidates(c.extents, corridor.suitability(c.inside, c.norms)))
query("candidate_reasons", "route_id:s cand_no:i factor:s text:s")(
    lambda c: corridor.explanations(c.inside).select("route_id", "cand_no", F.inline("reasons")))
query("candidate_planning", "route_id:s cand_no:i candidate_id:s target_segment:s cost_index:i")(
    lambda c: corridor.planning_candidates(c.inside, c.candidates))

# The whole route as one zone: the same figures without the greedy choice of the extent, which SQL can check.
_whole = lambda c: c.stretch_records.withColumn("cand_no", F.lit(1))
_mean = lambda x: f"sum({x} * length_m) / sum(CASE WHEN {x} IS NOT NULL THEN length_m END)"
_SUIT = {f"s_{k}": w for k, w in conf.SUITABILITY_WEIGHTS.items()}
query("route_suitability", "route_id:s raw_score:d suitability:d screening:s traffic_pressure:d junction_bottleneck:d historical_growth:d accident_risk:d", f"""
SELECT *, round_even(raw_score, 0) AS suitability, CASE WHEN raw_score >= 70 THEN 'strong' WHEN raw_score >= 50 THEN 'moderate' WHEN raw_score IS NOT NULL THEN 'weak' END AS screening,
  s_traffic_pressure AS traffic_pressure, s_junction_bottleneck AS junction_bottleneck, s_historical_growth AS historical_growth, s_accident_risk AS accident_risk
FROM (SELECT *, {_wmean(_SUIT)} AS raw_score FROM (
SELECT route_id, {_mean('n_flow')} AS s_traffic_pressure, {_mean('bottleneck_score')} AS s_junction_bottleneck, {_mean('n_delay')} AS s_delay,
  {_mean('n_util')} AS s_capacity_utilization, CASE WHEN count(growth_pct) > 0 THEN sum(coalesce(n_growth, 0) * length_m) / sum(length_m) END AS s_historical_growth,
  {_mean('n_inc')} AS s_accident_risk
FROM (SELECT *, {_norm('peak_flow_vph')} AS n_flow, {_norm('delay_min_per_km')} AS n_delay, least(greatest(utilization, 0), 1) * 100 AS n_util,
        {_norm('growth_pct')} AS n_growth, {_norm('incidents_per_km')} AS n_inc FROM records WHERE data_status = 'MATCHED') GROUP BY 1))""", **RECORDS)(
    lambda c: corridor.suitability(_whole(c), c.norms))
_FACTS = f"""
SELECT route_id, count(*) AS n, {_mean('capacity_utilization_pct')} AS util, count(*) FILTER (average_speed < 0.8::DOUBLE * free_flow_kmh) AS n_slow,
  count(*) FILTER (signal_delay_rounded >= 20) AS n_sig, max(signal_delay_rounded) AS worst, coalesce(sum(junction_count), 0) AS junctions,
  {_mean('historical_congestion_pct')} AS pers, {_mean('growth_rounded')} AS growth, count(*) FILTER (signal_count > 0) AS n_signalised, min(lanes) AS min_lanes
FROM records GROUP BY 1"""
query("route_reason_flags", "route_id:s because_capacity:b because_speed:b because_signals:b because_junctions:b because_persistence:b because_growth:b because_incidents:b", """
SELECT route_id, coalesce(util >= 70, false) AS because_capacity, n_slow > 0 AS because_speed, n_sig > 0 AS because_signals, junctions >= 3 AS because_junctions,
  coalesce(pers >= 30, false) AS because_persistence, coalesce(growth >= 3, false) AS because_growth,
  (SELECT coalesce(sum(i), 0) FROM (SELECT grid_segment_id, max(incidents) AS i FROM records r WHERE r.route_id = f.route_id GROUP BY 1)) > 0 AS because_incidents
FROM zone_facts f""", zone_facts=_FACTS, **RECORDS)(lambda c: corridor.explanations(_whole(c)))
query("route_alternatives", "route_id:s option:s supported:b", """
SELECT route_id, o.option, o.supported FROM (SELECT f.*, coalesce(w.n_routes, 0) AS n_routes FROM zone_facts f LEFT JOIN ways w USING (route_id)), LATERAL (VALUES ('Signal optimization', n_signalised > 0 AND coalesce(worst, 0) >= 10),
  ('Intelligent signal control', n_signalised >= 2), ('Junction redesign', junctions >= 3), ('Lane optimization', min_lanes <= 3 AND coalesce(util, 0) >= 80),
  ('Bus priority', NULL), ('Traffic diversion', n_routes >= 2), ('Underpass', NULL)) o(option, supported)""", zone_facts=_FACTS,
      ways="SELECT route_id, count(*) OVER (PARTITION BY trip_id) AS n_routes FROM (SELECT DISTINCT route_id, trip_id FROM route_nodes)", **RECORDS)(
    lambda c: corridor.alternatives(_whole(c), corridor.routes_per_trip(c.trips)))
_CONFIDENCE = """
SELECT *, round_even((coverage * 0.35::DOUBLE + history * 0.2::DOUBLE + 0.3::DOUBLE * 0.15::DOUBLE + 0.15::DOUBLE + field_completeness * 0.15::DOUBLE) * 100, 0) AS confidence FROM (
SELECT route_id, sum(CASE WHEN data_status = 'MATCHED' THEN length_m ELSE 0 END) / sum(length_m) AS coverage,
  least(1, coalesce(max(history_days), 0) / 14) AS history,
  (CASE WHEN count(road_name) FILTER (data_status = 'MATCHED') > 0 THEN 1 ELSE 0 END + CASE WHEN count(road_class) > 0 THEN 1 ELSE 0 END + CASE WHEN count(lanes) > 0 THEN 1 ELSE 0 END
   + CASE WHEN count(junction_count) FILTER (data_status = 'MATCHED') > 0 THEN 1 ELSE 0 END + CASE WHEN count(signal_count) > 0 THEN 1 ELSE 0 END
   + CASE WHEN count(traffic_volume) > 0 THEN 1 ELSE 0 END + CASE WHEN count(average_speed) > 0 THEN 1 ELSE 0 END + CASE WHEN count(incidents) > 0 THEN 1 ELSE 0 END) / 13 AS field_completeness
FROM records GROUP BY 1)"""
query("corridor_confidence", "route_id:s coverage:d history:d field_completeness:d confidence:d", _CONFIDENCE, **RECORDS)(lambda c: corridor.data_confidence(c.stretch_records, c.cfg))
query("corridor_summary", "route_id:s distance_km:d free_flow_time_min:d estimated_time_min:d stretches:i n_critical:i n_high:i n_moderate:i n_low:i n_no_data:i "
      "coverage_pct:d congestion_index:d traffic_status:s", f"""
SELECT route_id, round_even(total_m / 1000, 2) AS distance_km, round_even(total_m / 1000 / 30 * 60, 1) AS free_flow_time_min,
  round_even(total_m / 1000 / 30 * 60 + coalesce(delay, 0), 1) AS estimated_time_min, stretches, n_critical, n_high, n_moderate, n_low, n_no_data,
  round_even(coverage, 0) AS coverage_pct, round_even(congestion, 0) AS congestion_index, {_level('congestion')} AS traffic_status FROM (
SELECT route_id, max(total_m) AS total_m, count(*) AS stretches, sum(delay_min) AS delay, count(*) FILTER (level = 'CRITICAL') AS n_critical,
  count(*) FILTER (level = 'HIGH') AS n_high, count(*) FILTER (level = 'MODERATE') AS n_moderate, count(*) FILTER (level = 'LOW') AS n_low,
  count(*) FILTER (level = 'NO_DATA') AS n_no_data, sum(CASE WHEN data_status = 'MATCHED' THEN length_m ELSE 0 END) / sum(length_m) * 100 AS coverage,
  {_mean('congestion_index')} AS congestion FROM records GROUP BY 1)""", **RECORDS)(
    lambda c: corridor.corridor_summary(c.stretch_records, c.route_facts.select("route_id", "duration_min")))
query("grade_separation", "route_id:s existing:s", """
SELECT route_id, string_agg(DISTINCT road_name, ',') AS existing FROM records WHERE regexp_matches(lower(road_name), 'flyover|underpass|bridge|overpass') GROUP BY 1""",
      **RECORDS)(lambda c: corridor.grade_separation(_whole(c)).withColumn("existing", F.concat_ws(",", "existing")))
RANKING_SQL = """
SELECT {kind} AS scoring, sum(p * (lower + q * 0.5::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) AS auc, sum(least(greatest(k - higher, 0), p + q) * p::DOUBLE / (p + q)) / max(k) AS precision_at_k,
  max(k) AS k, sum(p + q) AS segments
FROM (SELECT *, sum(p) OVER () AS k, coalesce(sum(q) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
  coalesce(sum(p + q) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS higher FROM (
  SELECT round(coalesce({expr}, 0), 9) AS v, count(*) FILTER (structural_bottleneck = 1) AS p, count(*) FILTER (structural_bottleneck <> 1) AS q
  FROM {rows} GROUP BY 1))"""
_B = {f"c_{k}": v for k, v in conf.BOTTLENECK_WEIGHTS.items()}
_WITHOUT = {k: v for k, v in _B.items() if k != "c_throughput_ceiling"}


def _benchmark(c):
    from ..functions.columns import weighted_mean
    scored = corridor.with_scores(c.segment_stats, c.norms).join(c.segments.select("segment_id", "structural_bottleneck"), "segment_id")
    out = None
    for name, weights in (("all components", _B), ("without ceiling", _WITHOUT)):
        rows = scored.select(F.round(F.coalesce(weighted_mean(weights), F.lit(0.0)), 9).alias("v"), (F.col("structural_bottleneck") == 1).alias("y"))
        part = corridor.ranking_quality(rows, "v", "y").withColumn("scoring", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_RANKED = "seg_scores JOIN segments USING (segment_id)"
query("corridor_benchmark", "scoring:s auc:d precision_at_k:d k:i segments:i", RANKING_SQL.format(kind="'all components'", expr=_wmean(_B), rows=_RANKED) + " UNION ALL "
      + RANKING_SQL.format(kind="'without ceiling'", expr=_wmean(_WITHOUT), rows=_RANKED), seg_scores=_scores("seg_stats", ""), **STATS)(_benchmark)

# ---- interventions, each route as a zone
_ZM = f"""
SELECT r.route_id AS zone_id, max(total_m) / 1000 AS length_km, {_mean('capacity_utilization_pct')} / 100 AS utilization, {_mean('average_speed')} AS speed,
  {_mean('free_flow_kmh')} AS ff, {_mean('traffic_volume')} AS volume, {_mean('road_capacity')} AS capacity, min(lanes) AS min_lanes, sum(signal_count) AS signals,
  max(coalesce(signal_delay_rounded, 0)) AS signal_delay_s, sum(coalesce(junction_count, 0)) AS junctions, {_mean('growth_rounded')} AS growth_pct,
  {_mean('congestion_index')} AS congestion_index, sum(delay_min) AS delay_min,
  (SELECT sum(i) FROM (SELECT max(incidents) AS i FROM records q WHERE q.route_id = r.route_id AND q.grid_segment_id IS NOT NULL GROUP BY q.grid_segment_id)) AS incidents
FROM records r WHERE data_status = 'MATCHED' GROUP BY r.route_id"""
_LAND = """
SELECT route_id AS zone_id, 55 + 5 * (z % 8) AS availability_pct, CAST(20 + 3 * (z % 7) AS DOUBLE) AS private_pct, z % 12 AS structures_affected,
  0.1::DOUBLE + 0.05::DOUBLE * (z % 10) AS difficulty, CASE z % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS utility_conflict,
  CASE WHEN route_id LIKE '%-H%' THEN 1 ELSE 0 END AS alt_routes
FROM (SELECT DISTINCT route_id, 10 * district + CASE WHEN route_id LIKE '%-V%' THEN 5 ELSE 0 END + CAST(right(route_id, 1) AS BIGINT) AS z
      FROM (SELECT route_id, CAST(regexp_extract(route_id, 'D([0-9]+)-', 1) AS BIGINT) AS district FROM route_nodes))"""
_IV = "SELECT * FROM (VALUES " + ", ".join(
    "('%s', %s)" % (r[0], ", ".join("CAST(NULL AS DOUBLE)" if v is None else f"{v}::DOUBLE" for v in r[1:])) for r in conf.INTERVENTIONS) + """)
  v(intervention, fixed_gain, gain_cap, signal_removal, demand_shift, land_need, base_construction, sensitivity, unit_cost)"""


def _impact_sql(source: str, growth: float, p: str) -> str:
    r = lambda u: f"(1 + 0.15::DOUBLE * pow(least({u}, 1.5::DOUBLE), 4))"
    return f"""
SELECT *, round_even(gain * 100, 0) AS {p}capacity_change_pct, round_even(({p}speed_after / {p}speed_before - 1) * 100, 0) AS {p}speed_change_pct,
  CASE WHEN {p}congestion_before <> 0 THEN round_even(-({p}congestion_before - {p}congestion_after) / {p}congestion_before * 100, 0) ELSE 0 END AS {p}congestion_change_pct,
  {p}congestion_after - {p}congestion_before AS {p}congestion_change_pts, round_even({p}delay_before - {p}delay_after, 1) AS {p}delay_saved_min,
  -round_even(CASE WHEN {p}delay_before > 0 THEN ({p}delay_before - {p}delay_after) / {p}delay_before ELSE 0 END * 0.5::DOUBLE * 100, 0) AS {p}emissions_change_pct
FROM (SELECT * EXCLUDE (t0, free, sig, u_b, u_a, t_b, t_a), round_even(length_km / t_b * 60, 1) AS {p}speed_before, round_even(length_km / t_a * 60, 1) AS {p}speed_after,
  round_even(greatest(0, 1 - length_km / t_b * 60 / ff) * 100, 0) AS {p}congestion_before, round_even(greatest(0, 1 - length_km / t_a * 60 / ff) * 100, 0) AS {p}congestion_after,
  round_even(greatest(t_b - free, 0), 1) AS {p}delay_before, round_even(greatest(t_a - free, 0), 1) AS {p}delay_after
FROM (SELECT *, greatest((t0 - sig) * {r('u_b')} / {r('utilization')} + sig, free) AS t_b,
    greatest((t0 - sig) * {r('u_a')} / {r('utilization')} + sig * (1 - signal_removal), free) AS t_a
  FROM (SELECT *, least(signals * signal_delay_s / 60, 0.5::DOUBLE * t0) AS sig, u_b * (1 - demand_shift) / (1 + gain) AS u_a
    FROM (SELECT * {'EXCLUDE (gain)' if p else ''}, length_km / greatest(speed, 1) * 60 AS t0, length_km / ff * 60 AS free, utilization * (1 + {growth}::DOUBLE) AS u_b,
            coalesce(fixed_gain, least(gain_cap, 1::DOUBLE / greatest(min_lanes, 1))) AS gain FROM {source}))))"""


COMPARE = {**RECORDS, "zone_m": _ZM, "land": _LAND, "ivs": _IV,
           "iv0": """
SELECT *, CASE WHEN intervention = 'signal_optimization' AND signals <= 0 THEN 'nothing here is signal-controlled'
    WHEN intervention = 'junction_redesign' AND junctions < 1 AND signals <= 0 THEN 'the zone contains no junction'
    WHEN intervention = 'traffic_diversion' AND alt_routes < 1 THEN 'every trip has a single way' END AS not_applicable,
  CASE WHEN intervention IN ('flyover', 'road_widening') THEN length_km WHEN intervention = 'road_extension' THEN length_km * 0.7::DOUBLE END AS built,
  CASE WHEN intervention IN ('flyover', 'road_widening') THEN length_km WHEN intervention = 'road_extension' THEN length_km * 0.7::DOUBLE
    WHEN intervention = 'junction_redesign' THEN greatest(1, least(6, round_even(CASE WHEN junctions <> 0 THEN CAST(junctions AS DOUBLE) ELSE signals END, 0)))
    WHEN intervention = 'signal_optimization' THEN greatest(1, round_even(signals, 0)) ELSE 1 END * unit_cost
    * CASE WHEN land_need > 0 THEN 1 + 0.01::DOUBLE * structures_affected ELSE 1 END AS raw_cost
FROM zone_m JOIN land USING (zone_id), ivs""",
           "iv1": _impact_sql("iv0", 0.0, ""), "iv2": _impact_sql("iv1", 0.2, "future_"),
           "iv3": """
SELECT *, max(efficiency) OVER (PARTITION BY zone_id) AS best FROM (SELECT *, CASE WHEN not_applicable IS NULL THEN traffic_raw / greatest(raw_cost, 0.5::DOUBLE) END AS efficiency FROM (
SELECT *, least(greatest(-congestion_change_pct, 0), 100) AS traffic_raw, least(greatest(-future_congestion_change_pct, 0), 100) AS long_raw,
  least(greatest(100 - land_need * (private_pct + least(structures_affected, 30)), 0), 100) AS land_raw,
  least(greatest(base_construction - sensitivity * difficulty * 2 - CASE utility_conflict WHEN 'Medium' THEN 5 WHEN 'High' THEN 10 ELSE 0 END, 0), 100) AS construction_raw FROM iv2))""",
           "iv4": """
SELECT *, round_even(traffic_impact * 0.35::DOUBLE + land_feasibility * 0.2::DOUBLE + construction_feasibility * 0.15::DOUBLE + cost_efficiency * 0.15::DOUBLE
    + long_term_impact * 0.15::DOUBLE, 0) AS overall FROM (
SELECT *, not_applicable IS NULL AS applicable, round_even(built, 2) AS built_km, CASE WHEN not_applicable IS NULL THEN round_even(raw_cost, 1) END AS cost,
  CASE WHEN not_applicable IS NULL THEN round_even(traffic_raw, 0) END AS traffic_impact, CASE WHEN not_applicable IS NULL THEN round_even(land_raw, 0) END AS land_feasibility,
  CASE WHEN not_applicable IS NULL THEN round_even(construction_raw, 0) END AS construction_feasibility, CASE WHEN not_applicable IS NULL THEN round_even(long_raw, 0) END AS long_term_impact,
  CASE WHEN not_applicable IS NULL THEN CASE WHEN best > 0 THEN round_even(100 * efficiency / best, 0) ELSE 0 END END AS cost_efficiency FROM iv3)""",
           "iv5": """
SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY applicable DESC, coalesce(overall, 0) DESC,
  list_position(['flyover', 'road_extension', 'road_widening', 'junction_redesign', 'signal_optimization', 'traffic_diversion'], intervention)) AS rank FROM iv4"""}


def _zone_rows(c):
    return compare.zone_metrics(c.stretch_records.withColumn("zone_id", F.col("route_id")),
                                c.stretch_records.groupBy(F.col("route_id").alias("zone_id")).agg(F.max("total_m").alias("length_m")))


def _land(c):
    number = (F.regexp_extract("zone_id", "D([0-9]+)-", 1).cast("long") * 10 + F.when(F.col("zone_id").contains("-V"), 5).otherwise(0)
              + F.right("zone_id", F.lit(1)).cast("long"))
    z = F.col("z")
    return c.trips.select(F.col("route_id").alias("zone_id"), F.col("is_default").cast("int").alias("alt_routes")).withColumn("z", number).select(
        "zone_id", "alt_routes", (z % 8 * 5 + 55).alias("availability_pct"), (z % 7 * 3 + 20).cast("double").alias("private_pct"),
        (z % 12).alias("structures_affected"), (z % 10 * 0.05 + 0.1).alias("difficulty"),
        F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (z % 3 + 1).cast("int")).alias("utility_conflict"))


_compared = lambda c: compare.evaluate(_zone_rows(c), _land(c))
query("zone_metrics", "zone_id:s length_km:d utilization:d speed:d ff:d volume:d capacity:d min_lanes:i signals:d signal_delay_s:d junctions:i incidents:i growth_pct:d "
      "congestion_index:d delay_min:d", "SELECT * FROM zone_m", **COMPARE)(_zone_rows)
_IMPACT = " ".join(f"{p}{n}:d" for p in ("", "future_") for n in ("speed_before", "speed_after", "congestion_before", "congestion_after", "delay_before", "delay_after",
                                                                  "capacity_change_pct", "speed_change_pct", "congestion_change_pct", "delay_saved_min", "emissions_change_pct"))
query("intervention_impact", f"zone_id:s intervention:s {_IMPACT}", "SELECT * FROM iv2", **COMPARE)(_compared)
query("intervention_scores", "zone_id:s intervention:s applicable:b not_applicable:s built_km:d cost:d traffic_impact:d land_feasibility:d construction_feasibility:d "
      "cost_efficiency:d long_term_impact:d overall:d rank:i", "SELECT * FROM iv5", **COMPARE)(_compared)
_RECOMMENDED = """
SELECT z.zone_id, CASE WHEN t.overall >= 45 AND t.traffic_impact >= 5 THEN t.intervention ELSE 'none' END AS action, t.overall, t.traffic_impact, r.intervention AS runner_up,
  t.overall >= 45 AND t.traffic_impact >= 5 AND t.congestion_before < 20 AS caution
FROM (SELECT DISTINCT zone_id FROM iv5) z LEFT JOIN iv5 t ON t.zone_id = z.zone_id AND t.applicable AND t.rank = 1
LEFT JOIN iv5 r ON r.zone_id = z.zone_id AND r.applicable AND r.rank = 2"""
query("intervention_recommendation", "zone_id:s action:s overall:d traffic_impact:d runner_up:s caution:b", _RECOMMENDED, **COMPARE)(lambda c: compare.recommend(_compared(c)))


# ---- the same comparison on the detected zones
def _detected(c):
    """Records inside the best extent of each detected zone, and the lengths of these extents."""
    inside = corridor.inside_first_extents(c.stretch_records, c.zones)
    lengths = inside.groupBy("zone_id", "route_id").agg((F.max("to_m") - F.min("from_m")).alias("length_m"))
    return compare.zone_metrics(inside, lengths.drop("route_id")), lengths.select("zone_id", "route_id")


def _compared_zones(c):
    metrics, of_route = _detected(c)
    land = _land(c).withColumnRenamed("zone_id", "route_id")
    return compare.evaluate(metrics, of_route.join(land, "route_id").drop("route_id"))


_ZONED = {**COMPARE, "zns": _ZONES, "firsts": _FIRST, "land0": _LAND,
          "zoned": """
SELECT r.* REPLACE (z.route_id || '-Z' || CAST(z.zone_no AS VARCHAR) AS route_id, (max(r.to_m) OVER w - min(r.from_m) OVER w) AS total_m), z.route_id AS on_route
FROM firsts z JOIN records r ON r.route_id = z.route_id AND r.idx BETWEEN z.first_idx AND z.last_idx WINDOW w AS (PARTITION BY z.route_id, z.zone_no)""",
          "zone_m": _ZM.replace("records", "zoned"),
          "land": "SELECT d.route_id AS zone_id, l.* EXCLUDE (zone_id) FROM (SELECT DISTINCT route_id, on_route FROM zoned) d JOIN land0 l ON l.zone_id = d.on_route"}
query("detected_zone_metrics", "zone_id:s length_km:d utilization:d speed:d ff:d volume:d capacity:d min_lanes:i signals:d signal_delay_s:d junctions:i incidents:i growth_pct:d "
      "congestion_index:d delay_min:d", "SELECT * FROM zone_m", **_ZONED)(lambda c: _detected(c)[0])
query("detected_zone_impact", f"zone_id:s intervention:s {_IMPACT}", "SELECT * FROM iv2", **_ZONED)(_compared_zones)
query("detected_zone_scores", "zone_id:s intervention:s applicable:b not_applicable:s built_km:d cost:d traffic_impact:d land_feasibility:d construction_feasibility:d "
      "cost_efficiency:d long_term_impact:d overall:d rank:i", "SELECT * FROM iv5", **_ZONED)(_compared_zones)
query("detected_zone_recommendation", "zone_id:s action:s overall:d traffic_impact:d runner_up:s caution:b", _RECOMMENDED, **_ZONED)(lambda c: compare.recommend(_compared_zones(c)))
query("detected_zone_planning", "zone_id:s candidate_id:s target_segment:s cost_index:i", """
SELECT DISTINCT z.route_id AS zone_id, k.candidate_id, k.target_segment, k.cost_index FROM zoned z JOIN candidates k ON k.target_segment = z.grid_segment_id""", **_ZONED)(
    lambda c: corridor.planning_candidates(corridor.inside_first_extents(c.stretch_records, c.zones).withColumn("cand_no", F.col("zone_id")), c.candidates)
    .withColumn("zone_id", F.col("cand_no")))
query("intervention_confidence", "route_id:s road_network:d traffic:d overall:d", """
SELECT route_id, road_network, traffic, round_even(traffic * 0.35::DOUBLE + road_network * 0.2::DOUBLE + 65 * 0.25::DOUBLE + 60 * 0.2::DOUBLE, 0) AS overall FROM (
SELECT r.route_id, round_even(count(road_name) / count(*) * 100, 0) AS road_network, any_value(k.confidence) AS traffic FROM records r JOIN sure k USING (route_id) GROUP BY 1)""",
      sure=_CONFIDENCE, **RECORDS)(lambda c: compare.confidence(c.stretch_records, corridor.data_confidence(c.stretch_records, c.cfg)))
