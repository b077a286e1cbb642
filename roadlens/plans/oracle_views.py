"""Named SQL views over the driver tables, written for another engine and used to check the Spark results."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["districts"] = "SELECT DISTINCT s_suppkey // 100 AS district FROM supplier"
VIEWS["lattice"] = """
SELECT d.district, CAST(n_nationkey AS BIGINT) AS k, n_nationkey + 25 * d.district AS node_id,
       CAST(n_nationkey % 5 AS BIGINT) AS x, CAST(n_nationkey // 5 AS BIGINT) AS y
FROM nation, districts d"""
VIEWS["nodes"] = """
SELECT node_id, x, y, 17.30::DOUBLE + y * 0.018::DOUBLE AS lat,
       78.35::DOUBLE + x * 0.018::DOUBLE + district * 0.126::DOUBLE AS lon FROM lattice"""
VIEWS["segs0"] = """
SELECT a.district, a.k AS s, b.k AS t, a.node_id AS source_node, b.node_id AS target_node,
       row_number() OVER (PARTITION BY a.district ORDER BY a.k, b.k) - 1 AS li
FROM lattice a JOIN lattice b ON a.district = b.district AND abs(a.x - b.x) + abs(a.y - b.y) = 1"""
VIEWS["segments"] = """
SELECT 'R' || CASE WHEN li + 80 * district + 1 >= 10000 THEN CAST(li + 80 * district + 1 AS VARCHAR)
                   ELSE lpad(CAST(li + 80 * district + 1 AS VARCHAR), 4, '0') END AS segment_id,
       li + 80 * district AS idx, source_node, target_node,
       CASE WHEN 2 + (s + t) % 3 >= 3 THEN 'arterial' ELSE 'collector' END AS road_class, 2 + (s + t) % 3 AS lanes,
       CAST(40 + 10 * ((3 * s + t) % 3) AS DOUBLE) AS free_flow_speed_kmh, CAST(900 * (2 + (s + t) % 3) AS DOUBLE) AS capacity_vph,
       0.8::DOUBLE + ((s + 2 * t) % 7) * 0.1::DOUBLE AS length_km, CAST((s + t) % 9 - 4 AS DOUBLE) AS grade_pct,
       0.6::DOUBLE + ((5 * s + 3 * t) % 80) * 0.01::DOUBLE AS importance,
       CASE WHEN t % 4 <> 0 THEN 'S' || CAST(target_node AS VARCHAR) END AS signal_id,
       CAST(li % 27 = 5 AS BIGINT) AS structural_bottleneck,
       CASE WHEN li % 27 = 5 THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END AS peak_capacity_factor
FROM segs0"""
VIEWS["signals"] = """
SELECT 'S' || CAST(node_id AS VARCHAR) AS signal_id, node_id, 60 + 10 * (k % 7) AS cycle_s,
       0.35::DOUBLE + (k % 10) * 0.02::DOUBLE AS green_ratio FROM lattice WHERE k % 4 <> 0"""
VIEWS["turn_restrictions"] = """
SELECT a.target_node AS node_id, a.segment_id AS from_segment, b.segment_id AS to_segment,
       CASE (a.idx + b.idx) % 3 WHEN 0 THEN 'no_turn' WHEN 1 THEN 'no_left' ELSE 'time_window' END AS restriction
FROM segments a JOIN segments b ON a.target_node = b.source_node
WHERE a.source_node <> b.target_node AND (7 * a.idx + b.idx) % 13 = 0"""
VIEWS["ev"] = """
SELECT e.event_id, e.ts, e.event_type, e.value, CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, s.*
FROM events e JOIN segments s ON e.event_id % (80 * (SELECT count(*) FROM districts)) = s.idx"""
VIEWS["readings"] = """
SELECT TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(floor(epoch_us(ts) / 21600000000) * 21600 AS BIGINT) AS ts,
  segment_id, event_id AS ingest_seq,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN -1 ELSE 1 END * free_flow_speed_kmh * (1 - least(value, 400::DOUBLE) / 500) AS speed_kmh,
  CASE WHEN event_type = 'signup' AND k = 99 THEN 10 ELSE 1 END * (capacity_vph * (0.2::DOUBLE + k * 0.006::DOUBLE)) AS flow_vph,
  CASE WHEN event_type = 'view' AND k = 98 THEN 150::DOUBLE ELSE 7::DOUBLE + k * 0.9::DOUBLE END AS occupancy_pct,
  60 * length_km / free_flow_speed_kmh * (1 / (1 - least(value, 400::DOUBLE) / 500) - 1) AS delay_min,
  value / 10 AS queue_length_veh, least(1::DOUBLE, value / 500) AS congestion_index,
  CASE WHEN k = 50 THEN 0.3::DOUBLE ELSE 1::DOUBLE END AS sensor_quality
FROM ev"""
VIEWS["slots"] = """
SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 18:00:00', INTERVAL 6 HOUR)) AS ts"""
VIEWS["context"] = """
SELECT ts, 20::DOUBLE + hour(ts) / 6::DOUBLE + (d % 10) * 0.5::DOUBLE AS temperature_c,
  CASE WHEN d % 6 = 3 THEN 0.4::DOUBLE + (d % 3) * 0.05::DOUBLE ELSE 0::DOUBLE END AS rain_intensity,
  CASE WHEN d % 10 = 7 AND hour(ts) = 18 THEN 1 ELSE 0 END AS event_level, CASE WHEN d IN (0, 14, 25) THEN 1 ELSE 0 END AS holiday_flag
FROM (SELECT ts, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM slots)"""
VIEWS["incidents"] = """
SELECT 'I' || CAST(event_id AS VARCHAR) AS incident_id, segment_id, ts AS start_time, ts + INTERVAL 13 HOUR AS end_time,
  CASE k % 5 WHEN 0 THEN 'accident_like' WHEN 1 THEN 'demand_surge' WHEN 2 THEN 'lane_blockage' WHEN 3 THEN 'road_closure'
             ELSE 'stalled_vehicle' END AS incident_type, 1 + k % 3 AS severity, 1 + k % 2 AS lanes_blocked
FROM ev WHERE event_type = 'click' AND value >= 150"""
VIEWS["inc_train"] = "SELECT * FROM incidents WHERE start_time < TIMESTAMP '2024-01-25 00:00:00'"
VIEWS["inc_val"] = "SELECT * FROM incidents WHERE start_time >= TIMESTAMP '2024-01-25 00:00:00'"
VIEWS["roadworks"] = """
SELECT 'W' || CAST(event_id AS VARCHAR) AS work_id, segment_id, ts AS start_time, ts + INTERVAL 18 HOUR AS end_time,
  0.2::DOUBLE + k * 0.005::DOUBLE AS closure_fraction, CASE k % 2 WHEN 0 THEN 'utility' ELSE 'resurfacing' END AS work_type
FROM ev WHERE event_type = 'signup' AND value >= 200"""
VIEWS["candidates"] = """
SELECT 'PLAN' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS candidate_id, s.segment_id AS target_segment,
  CASE p_partkey % 5 WHEN 0 THEN 'capacity_upgrade' WHEN 1 THEN 'connector' WHEN 2 THEN 'lane_addition' WHEN 3 THEN 'signal_retiming'
                     ELSE 'turn_lane' END AS intervention_type,
  CAST(100 * (1 + p_size % 9) AS BIGINT) AS capacity_delta_vph, CAST(1 + p_size % 18 AS BIGINT) AS cost_index,
  CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS feasibility_band
FROM part JOIN segments s ON p_partkey % (80 * (SELECT count(*) FROM districts)) = s.idx"""
VIEWS["od_demand"] = """
SELECT CAST(s_nationkey AS BIGINT) AS origin_node, CAST(c_nationkey AS BIGINT) AS destination_node, sum(l_quantity) AS base_demand_vph
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY ALL"""
VIEWS["route_nodes"] = """
SELECT 'D' || CAST(district AS VARCHAR) || '-H' || CAST(y AS VARCHAR) AS route_id,
       'D' || CAST(district AS VARCHAR) || '-T' || CAST(y AS VARCHAR) AS trip_id, true AS is_default, x AS seq,
       17.30::DOUBLE + y * 0.018::DOUBLE + 0.001::DOUBLE AS lat,
       78.35::DOUBLE + x * 0.018::DOUBLE + district * 0.126::DOUBLE + 0.001::DOUBLE AS lon FROM lattice
UNION ALL
SELECT 'D' || CAST(district AS VARCHAR) || '-V' || CAST(x AS VARCHAR),
       'D' || CAST(district AS VARCHAR) || '-T' || CAST(x AS VARCHAR), false, y,
       17.30::DOUBLE + y * 0.018::DOUBLE + 0.001::DOUBLE,
       78.35::DOUBLE + x * 0.018::DOUBLE + district * 0.126::DOUBLE + 0.001::DOUBLE FROM lattice"""
VIEWS["pois"] = """
SELECT 'n' || CAST(s_suppkey AS VARCHAR) AS poi_id, s_name AS name,
  CASE s_nationkey % 6 WHEN 0 THEN 'hospital' WHEN 1 THEN 'fuel' WHEN 2 THEN 'food' WHEN 3 THEN 'bus' WHEN 4 THEN 'metro' ELSE 'parking' END AS category,
  17.30::DOUBLE + (s_suppkey * 37 % 100) / 100::DOUBLE * 0.072::DOUBLE AS lat,
  78.35::DOUBLE + (s_suppkey * 53 % 100) / 100::DOUBLE * 0.072::DOUBLE + (s_suppkey // 100) * 0.126::DOUBLE AS lon FROM supplier"""

# ---- grid
VIEWS["dedup"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id, ts ORDER BY ingest_seq) AS rn, count(*) OVER (PARTITION BY segment_id, ts) AS copies
  FROM readings) WHERE rn = 1"""
VIEWS["cells"] = """
SELECT s.segment_id, s.free_flow_speed_kmh AS ff, s.capacity_vph AS cap, t.ts, d.* EXCLUDE (segment_id, ts)
FROM segments s CROSS JOIN slots t LEFT JOIN dedup d ON d.segment_id = s.segment_id AND d.ts = t.ts"""
VIEWS["same0"] = """
SELECT *, lag(flow_vph) OVER w AS prev_flow,
  coalesce(speed_kmh = lag(speed_kmh) OVER w AND flow_vph = lag(flow_vph) OVER w AND occupancy_pct = lag(occupancy_pct) OVER w, false) AS same
FROM cells WINDOW w AS (PARTITION BY segment_id ORDER BY ts)"""
VIEWS["runs0"] = """
SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id ORDER BY ts) AS island FROM same0"""
VIEWS["judged"] = """
SELECT *, negative OR impossible OR spike OR stuck OR low_quality AS rejected,
  speed_kmh IS NOT NULL AND NOT (negative OR impossible OR spike OR stuck OR low_quality) AS valid
FROM (SELECT *,
  coalesce(speed_kmh < 0, false) OR coalesce(flow_vph < 0, false) OR coalesce(occupancy_pct < 0, false) OR coalesce(delay_min < 0, false)
    OR coalesce(queue_length_veh < 0, false) OR coalesce(congestion_index < 0, false) AS negative,
  coalesce(speed_kmh > 1.5::DOUBLE * ff, false) OR coalesce(occupancy_pct > 100, false) OR coalesce(congestion_index > 1, false) AS impossible,
  coalesce(flow_vph > 2.5::DOUBLE * cap, false) OR coalesce(flow_vph > 3 * prev_flow + 300 AND flow_vph > cap, false) AS spike,
  row_number() OVER (PARTITION BY segment_id, island ORDER BY ts) - 1 >= 3
    AND NOT (coalesce(occupancy_pct >= 97, false) OR coalesce(flow_vph <= 0, false)) AS stuck,
  coalesce(sensor_quality < 0.5::DOUBLE, false) AS low_quality FROM runs0)"""


def _fill(c: str) -> str:
    masked = f"CASE WHEN NOT rejected THEN {c} END"
    return f"last_value({masked} IGNORE NULLS) OVER f AS {c}"


VIEWS["panel"] = "SELECT segment_id, ts, " + ", ".join(
    _fill(c) for c in ("speed_kmh", "flow_vph", "occupancy_pct", "delay_min", "queue_length_veh", "congestion_index")) + """,
  valid, avg(CAST(valid AS INT)) OVER q AS quality
FROM judged WINDOW f AS (PARTITION BY segment_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  q AS (PARTITION BY segment_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""

# ---- network
VIEWS["twins"] = """
SELECT a.*, b.segment_id AS twin_id FROM segments a
LEFT JOIN segments b ON a.source_node = b.target_node AND a.target_node = b.source_node"""
VIEWS["edges"] = """
SELECT a.segment_id, b.segment_id AS neighbor_id, 'upstream' AS direction FROM twins a
JOIN segments b ON b.target_node = a.source_node WHERE a.twin_id IS NULL OR b.segment_id <> a.twin_id
UNION ALL
SELECT a.segment_id, b.segment_id, 'downstream' FROM twins a
JOIN segments b ON b.source_node = a.target_node WHERE a.twin_id IS NULL OR b.segment_id <> a.twin_id"""
VIEWS["turns"] = """
SELECT k.bucket, a.segment_id AS from_segment, b.segment_id AS to_segment
FROM segments a JOIN segments b ON a.target_node = b.source_node, (VALUES ('peak'), ('offpeak')) k(bucket)
WHERE NOT EXISTS (SELECT 1 FROM turn_restrictions r WHERE r.from_segment = a.segment_id AND r.to_segment = b.segment_id
                  AND (r.restriction IN ('no_turn', 'no_left') OR (r.restriction = 'time_window' AND k.bucket = 'peak')))"""
VIEWS["reach1"] = """
SELECT segment_id, neighbor_id AS reached_id, 1 AS hop, max(direction) AS direction FROM edges
WHERE segment_id <> neighbor_id GROUP BY ALL"""
VIEWS["reach2"] = """
SELECT r.segment_id, e.neighbor_id AS reached_id, 2 AS hop, max(r.direction) AS direction
FROM reach1 r JOIN edges e ON r.reached_id = e.segment_id AND r.direction = e.direction
WHERE e.neighbor_id <> r.segment_id AND NOT EXISTS (SELECT 1 FROM reach1 p WHERE p.segment_id = r.segment_id AND p.reached_id = e.neighbor_id)
GROUP BY ALL"""
VIEWS["reach3"] = """
SELECT r.segment_id, e.neighbor_id AS reached_id, 3 AS hop, max(r.direction) AS direction
FROM reach2 r JOIN edges e ON r.reached_id = e.segment_id AND r.direction = e.direction
WHERE e.neighbor_id <> r.segment_id AND NOT EXISTS (
  SELECT 1 FROM (SELECT segment_id, reached_id FROM reach1 UNION ALL SELECT segment_id, reached_id FROM reach2) p
  WHERE p.segment_id = r.segment_id AND p.reached_id = e.neighbor_id)
GROUP BY ALL"""
VIEWS["reach"] = "SELECT * FROM reach1 UNION ALL SELECT * FROM reach2 UNION ALL SELECT * FROM reach3"

# ---- detection
VIEWS["ratios"] = """
SELECT p.*, s.free_flow_speed_kmh, s.capacity_vph, p.speed_kmh / s.free_flow_speed_kmh AS speed_ratio,
  p.flow_vph / s.capacity_vph AS flow_ratio,
  CASE WHEN isodow(p.ts) >= 6 OR c.holiday_flag > 0 THEN 1 ELSE 0 END AS daytype
FROM panel p JOIN segments s USING (segment_id) LEFT JOIN context c ON c.ts = p.ts"""
_CEIL = "TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(ceil(epoch_us(start_time) / 21600000000) * 21600 AS BIGINT)"
VIEWS["inc_slots"] = f"""
SELECT i.*, t.ts FROM incidents i JOIN slots t ON t.ts >= {_CEIL} AND t.ts <= i.end_time"""
VIEWS["rw_slots"] = f"""
SELECT DISTINCT w.segment_id, t.ts FROM roadworks w JOIN slots t ON t.ts >= {_CEIL} AND t.ts <= w.end_time"""
VIEWS["inc_mask"] = "SELECT DISTINCT segment_id, ts FROM inc_slots"
VIEWS["labelled"] = "SELECT * FROM inc_mask UNION SELECT * FROM rw_slots"
VIEWS["rw_active"] = """
SELECT w.segment_id, t.ts, count(*) AS works, arg_min(work_type, (start_time, work_id)) AS work_type
FROM roadworks w JOIN slots t ON t.ts >= w.start_time AND t.ts < w.end_time GROUP BY ALL"""
VIEWS["clean_train"] = """
SELECT r.*, hour(r.ts) AS hour FROM ratios r ANTI JOIN labelled l ON l.segment_id = r.segment_id AND l.ts = r.ts
WHERE r.ts <= TIMESTAMP '2024-01-24 18:00:00'"""
VIEWS["med0"] = """
SELECT segment_id, hour, daytype, median(speed_ratio) AS sr_med, median(flow_ratio) AS fr_med FROM clean_train GROUP BY ALL"""
VIEWS["baseline"] = """
SELECT segment_id, hour, daytype, any_value(m.sr_med) AS sr_med, median(abs(speed_ratio - m.sr_med)) AS sr_mad,
  any_value(m.fr_med) AS fr_med, median(abs(flow_ratio - m.fr_med)) AS fr_mad
FROM clean_train JOIN med0 m USING (segment_id, hour, daytype) GROUP BY ALL"""
VIEWS["drops"] = """
SELECT r.*, b.sr_med, b.sr_mad, b.fr_med, b.fr_mad, b.sr_med - r.speed_ratio AS drop
FROM ratios r LEFT JOIN baseline b ON b.segment_id = r.segment_id AND b.hour = hour(r.ts) AND b.daytype = r.daytype"""
VIEWS["shift"] = "SELECT ts, greatest(median(drop), 0) AS net_shift FROM drops GROUP BY ts HAVING count(drop) > 0"
VIEWS["local0"] = """
SELECT d.*, n.net_shift, coalesce(drop - net_shift, 0) AS local_drop,
  (drop - net_shift) / greatest(1.4826::DOUBLE * sr_mad, 0.02::DOUBLE) AS z_speed,
  (fr_med - flow_ratio) / greatest(1.4826::DOUBLE * fr_mad, 0.05::DOUBLE) AS z_flow
FROM drops d LEFT JOIN shift n USING (ts)"""
VIEWS["components"] = """
SELECT *, drop_epicentre AS score, drop_epicentre >= 0.2::DOUBLE AS anomalous FROM (
SELECT l.*, coalesce(m.top, 0) AS neighbor_max_drop,
  CASE WHEN l.local_drop >= coalesce(m.top, 0) THEN l.local_drop ELSE 0 END AS drop_epicentre,
  coalesce(0.8::DOUBLE * CASE WHEN z_speed IS NULL THEN NULL ELSE greatest(z_speed, 0) END
         + 0.2::DOUBLE * CASE WHEN z_flow IS NULL THEN NULL ELSE greatest(z_flow, 0) END, 0) AS z_composite,
  CASE WHEN speed_ratio >= 0.85::DOUBLE THEN 'NORMAL' WHEN speed_ratio >= 0.70::DOUBLE THEN 'MODERATE'
       WHEN speed_ratio >= 0.50::DOUBLE THEN 'HEAVY' WHEN speed_ratio >= 0 THEN 'CRITICAL' ELSE 'NO_DATA' END AS state
FROM local0 l LEFT JOIN (SELECT e.segment_id, n.ts, max(n.local_drop) AS top FROM edges e JOIN local0 n ON n.segment_id = e.neighbor_id
                         GROUP BY ALL) m ON m.segment_id = l.segment_id AND m.ts = l.ts)"""


def noise_free(sql: str) -> str:
    """Round the argument of every ``round_even`` to nine digits first, so that noise does not decide an exact half."""
    out, mark = [], "round_even("
    while mark in sql:
        head, rest = sql.split(mark, 1)
        depth, comma = 0, 0
        for comma, ch in enumerate(rest):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                break
        out.append(f"{head}half_even_(round({noise_free(rest[:comma])}, 9)")
        sql = rest[comma:]
    return "".join([*out, sql]).replace("half_even_(", mark)


def oracle(body: str, **local: str) -> str:
    """The statement with every view it needs, directly or through other views, in front of it."""
    known = {**VIEWS, **local}
    need: list[str] = []

    def visit(sql: str, me: str = "") -> None:
        for name in known:
            if name != me and name not in need and re.search(rf"\b{name}\b(?!\s*\()", sql):
                visit(known[name], name)
                if name not in need:
                    need.append(name)

    visit(body)
    known, body = {n: noise_free(known[n]) for n in need}, noise_free(body)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n].strip()})" for n in need) + "\n" + body.strip() if need else body
