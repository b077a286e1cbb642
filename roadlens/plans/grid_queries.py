"""Queries over the grid, the network and the features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..conf import SIX_HOURLY
from ..functions import slots
from ..operators import features, graph, panel
from .registry import query

# ---- grid
query("dedupe_first", "segment_id:s ts:t ingest_seq:i speed_kmh:d copies:i",
      "SELECT segment_id, ts, ingest_seq, speed_kmh, copies FROM dedup")(
    lambda c: panel.one_per_cell(panel.known_rows(c.readings, c.segments)))

query("dedupe_last", "segment_id:s ts:t ingest_seq:i speed_kmh:d valid:b quality:d", """
SELECT segment_id, t.ts, ingest_seq, speed_kmh, speed_kmh IS NOT NULL AS valid,
  avg(CASE WHEN speed_kmh IS NOT NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY segment_id ORDER BY t.ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS quality
FROM (SELECT segment_id FROM segments) s CROSS JOIN slots t
LEFT JOIN (SELECT segment_id, ts, max(ingest_seq) AS ingest_seq, arg_max(speed_kmh, ingest_seq) AS speed_kmh FROM readings GROUP BY ALL) d
  USING (segment_id, ts)""")(
    lambda c: panel.naive(c.readings, c.segments, c.cfg).join(
        c.readings.groupBy("segment_id", "ts").agg(F.max("ingest_seq").alias("ingest_seq")), ["segment_id", "ts"], "left"))

query("range_scan_splits", "ts:t segment_id:s ingest_seq:i speed_kmh:d flow_vph:d occupancy_pct:d delay_min:d queue_length_veh:d "
      "congestion_index:d sensor_quality:d", """
SELECT * FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-27 18:00:00'""")(
    lambda c: _splits(c))


def _splits(c):
    """Rows of two splits that do not overlap in time, each filtered by the requested range."""
    from ..sources.tables import range_scan
    train = c.readings.filter(F.col("ts") < slots.at(c.cfg.val_start))
    later = c.readings.filter(F.col("ts") >= slots.at(c.cfg.val_start))
    return range_scan([train, later], "2024-01-20 00:00:00", "2024-01-27 18:00:00")


query("grid_flags", "segment_id:s ts:t negative:b impossible:b spike:b stuck:b low_quality:b rejected:b valid:b",
      "SELECT segment_id, ts, negative, impossible, spike, stuck, low_quality, rejected, valid FROM judged")(
    lambda c: c.checked_cells)

query("sanitized_panel", "segment_id:s ts:t speed_kmh:d flow_vph:d occupancy_pct:d delay_min:d queue_length_veh:d congestion_index:d "
      "valid:b quality:d", "SELECT * FROM panel")(
    lambda c: panel.sanitized(c.readings, c.segments, c.cfg))

query("sanitizer_report", "rows_in:i rows_outside:i duplicates_removed:i missing_cells:i negative_cells:i impossible_cells:i spike_cells:i "
      "stuck_cells:i cells_rejected:i cells_unfilled:i quality_ratio:d", """
SELECT (SELECT count(*) FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-30 18:00:00') AS rows_in,
  (SELECT count(*) FROM readings WHERE ts < TIMESTAMP '2024-01-01 00:00:00' OR ts > TIMESTAMP '2024-01-30 18:00:00') AS rows_outside, (SELECT sum(copies - 1) FROM dedup) AS duplicates_removed,
  count(*) FILTER (speed_kmh IS NULL) AS missing_cells, count(*) FILTER (negative) AS negative_cells,
  count(*) FILTER (impossible AND NOT negative) AS impossible_cells,
  count(*) FILTER (spike AND NOT negative AND NOT impossible) AS spike_cells, count(*) FILTER (stuck) AS stuck_cells,
  count(*) FILTER (rejected) AS cells_rejected, (SELECT count(*) FROM panel WHERE speed_kmh IS NULL) AS cells_unfilled,
  avg(CASE WHEN valid THEN 1 ELSE 0 END) AS quality_ratio FROM judged""")(
    lambda c: panel.report(c.readings, c.segments, c.cfg))

# Stuck sensors do not occur in the derived readings: repeat one reading of every twentieth segment over a day and a half.
_STUCK = """
SELECT * REPLACE (CASE WHEN held THEN first_value(speed_kmh) OVER w ELSE speed_kmh END AS speed_kmh,
                  CASE WHEN held THEN first_value(flow_vph) OVER w ELSE flow_vph END AS flow_vph,
                  CASE WHEN held THEN first_value(occupancy_pct) OVER w ELSE occupancy_pct END AS occupancy_pct)
FROM (SELECT c.*, (s.idx % 20 = 3 AND c.ts >= TIMESTAMP '2024-01-10 00:00:00' AND c.ts < TIMESTAMP '2024-01-12 00:00:00') AS held
      FROM cells c JOIN segments s USING (segment_id)) WINDOW w AS (PARTITION BY segment_id, held ORDER BY ts)"""
query("stuck_sensors", "segment_id:s ts:t stuck:b", """
SELECT segment_id, ts, row_number() OVER (PARTITION BY segment_id, island ORDER BY ts) - 1 >= 3
    AND NOT (coalesce(occupancy_pct >= 97, false) OR coalesce(flow_vph <= 0, false)) AS stuck
FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id ORDER BY ts) AS island FROM (
  SELECT *, coalesce(speed_kmh = lag(speed_kmh) OVER w AND flow_vph = lag(flow_vph) OVER w
                     AND occupancy_pct = lag(occupancy_pct) OVER w, false) AS same
  FROM held_cells WINDOW w AS (PARTITION BY segment_id ORDER BY ts)))""", held_cells=_STUCK)(lambda c: _stuck(c))


def _stuck(c):
    from pyspark.sql import Window
    held = ((F.col("idx") % 20 == 3) & (F.col("ts") >= slots.at("2024-01-10 00:00:00")) & (F.col("ts") < slots.at("2024-01-12 00:00:00")))
    rows = c.raw_cells.join(c.segments.select("segment_id", "idx"), "segment_id").withColumn("held", held)
    w = Window.partitionBy("segment_id", "held").orderBy("ts")
    rows = rows.withColumns({x: F.when(F.col("held"), F.first(x).over(w)).otherwise(F.col(x))
                             for x in ("speed_kmh", "flow_vph", "occupancy_pct")})
    return panel.judged(rows)


query("as_of_window", "segment_id:s ts:t speed_kmh:d quality:d", """
SELECT segment_id, ts, speed_kmh, quality FROM panel
WHERE ts BETWEEN TIMESTAMP '2024-01-26 12:00:00' - INTERVAL 42 HOUR AND TIMESTAMP '2024-01-26 12:00:00'""")(
    lambda c: panel.as_of(c.dated_panel, "2024-01-26 13:30:00", c.cfg))

query("floor_to_grid", "event_id:i slot:t", """
SELECT event_id, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(floor(epoch_us(ts) / 21600000000) * 21600 AS BIGINT) AS slot FROM events
WHERE ts < TIMESTAMP '2024-01-31 00:00:00'""")(
    lambda c: panel.checked_time(c._events.select("event_id", F.col("event_ts").alias("slot")), "slot", c.cfg))

query("fit_boundary", "part:s cells:i first:t last:t", """
SELECT 'fit' AS part, count(*) AS cells, min(ts) AS first, max(ts) AS last FROM panel WHERE ts <= TIMESTAMP '2024-01-24 18:00:00'
UNION ALL SELECT 'runtime', count(*), min(ts), max(ts) FROM panel""")(
    lambda c: panel.fit_panel(c.dated_panel, c.cfg.with_(val_end=c.cfg.train_end)).agg(
        F.lit("fit").alias("part"), F.count("*").alias("cells"), F.min("ts").alias("first"), F.max("ts").alias("last")).unionByName(
        c.panel.agg(F.lit("runtime").alias("part"), F.count("*").alias("cells"), F.min("ts").alias("first"), F.max("ts").alias("last"))))

# ---- network
query("twin_segments", "segment_id:s twin_id:s", "SELECT segment_id, twin_id FROM twins")(lambda c: graph.twins(c.segments))
query("neighbors", "segment_id:s neighbor_id:s direction:s", "SELECT * FROM edges")(lambda c: graph.neighbors(c.segments))
query("legal_turns", "bucket:s from_segment:s to_segment:s", "SELECT * FROM turns")(lambda c: c.legal_turns)
query("blocked_turns_by_hour", "node_id:i from_segment:s to_segment:s hour:i restriction:s", """
SELECT r.node_id, r.from_segment, r.to_segment, h.hour, r.restriction
FROM turn_restrictions r, (VALUES (0), (6), (12), (18), (NULL)) h(hour)
WHERE r.restriction IN ('no_turn', 'no_left') OR (r.restriction = 'time_window' AND (h.hour IS NULL OR h.hour IN (6, 18)))""")(
    lambda c: graph.blocked_turns(
        c.turn_restrictions.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in (0, 6, 12, 18)], F.lit(None).cast("int")))),
        F.col("hour"), c.cfg))
query("hops3", "segment_id:s reached_id:s hop:i direction:s", "SELECT * FROM reach")(lambda c: graph.hops(c.segments))
query("neighbor_means", "segment_id:s ts:t up_congestion:d down_congestion:d up_sr:d down_sr:d up_flow:d", """
SELECT r.segment_id, r.ts, coalesce(up_congestion, 0) AS up_congestion, coalesce(down_congestion, 0) AS down_congestion,
  coalesce(up_sr, 0) AS up_sr, coalesce(down_sr, 0) AS down_sr, coalesce(up_flow, 0) AS up_flow
FROM ratios r LEFT JOIN beside b USING (segment_id, ts)""", beside="""
SELECT e.segment_id, n.ts,
  avg(coalesce(n.congestion_index, 0)) FILTER (direction = 'upstream') AS up_congestion,
  avg(coalesce(n.congestion_index, 0)) FILTER (direction = 'downstream') AS down_congestion,
  avg(coalesce(n.speed_ratio, 1)) FILTER (direction = 'upstream') AS up_sr,
  avg(coalesce(n.speed_ratio, 1)) FILTER (direction = 'downstream') AS down_sr,
  avg(coalesce(n.flow_vph, 0)) FILTER (direction = 'upstream') AS up_flow
FROM edges e JOIN ratios n ON n.segment_id = e.neighbor_id GROUP BY ALL""")(
    lambda c: graph.neighbor_means(features.with_ratios(c.panel, c.segments), c.edges))
query("path_legality", "bucket:s path_id:s legal:b", """
SELECT k.bucket, a.segment_id || '>' || b.segment_id || '>' || c.segment_id AS path_id,
  EXISTS (SELECT 1 FROM turns t WHERE t.from_segment = a.segment_id AND t.to_segment = b.segment_id AND t.bucket = k.bucket)
  AND EXISTS (SELECT 1 FROM turns t WHERE t.from_segment = b.segment_id AND t.to_segment = c.segment_id AND t.bucket = k.bucket) AS legal
FROM segments a JOIN segments b ON b.source_node = a.target_node JOIN segments c ON c.source_node = b.target_node, (VALUES ('peak'), ('offpeak')) k(bucket)""")(
    lambda c: _paths(c))


def _paths(c):
    """Every way over three segments, restricted turns included, judged in both parts of the day."""
    part = lambda k: c.segments.select(F.col("segment_id").alias(f"s{k}"), F.col("source_node").alias(f"n{k}"), F.col("target_node").alias(f"n{k + 1}"))
    ways = part(0).join(part(1), "n1").join(part(2), "n2").select(F.array("s0", "s1", "s2").alias("path"))
    return graph.path_legality(ways.withColumn("path_id", F.concat_ws(">", "path")), c.segments, c.legal_turns)


query("network_summary", "metric:s value:i", """
SELECT 'nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'segments', count(*) FROM segments
UNION ALL SELECT 'turn_restrictions', count(*) FROM turn_restrictions
UNION ALL SELECT 'legal_turns_' || bucket, count(*) FROM turns GROUP BY bucket
UNION ALL SELECT 'out_degree_' || CAST(d AS VARCHAR), count(*) FROM (
  SELECT n.node_id, count(s.segment_id) AS d FROM nodes n LEFT JOIN segments s ON s.source_node = n.node_id GROUP BY 1) GROUP BY d""")(
    lambda c: graph.summary(c.nodes, c.segments, c.turn_restrictions, c.legal_turns))
_REACHED = """
SELECT * FROM (WITH RECURSIVE f AS (SELECT min(node_id) AS n FROM nodes UNION SELECT s.{b} FROM f JOIN segments s ON s.{a} = f.n) SELECT * FROM f)"""
query("strong_connectivity", "nodes:i strongly_connected:b", """
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM onward) = (SELECT count(*) FROM nodes) AND (SELECT count(*) FROM backward) = (SELECT count(*) FROM nodes)
  AS strongly_connected""", onward=_REACHED.format(a="source_node", b="target_node"), backward=_REACHED.format(a="target_node", b="source_node"))(
    lambda c: c.nodes.agg(F.count("*").alias("nodes")).withColumn(
        "strongly_connected", F.lit(graph.strongly_connected(c.segments, c.nodes))))
WAYS = """
SELECT * FROM (WITH RECURSIVE w AS (
  SELECT k.bucket, b.segment_id AS blocked_id, b.target_node AS goal, s.segment_id, s.target_node AS at_node,
         s.length_km / s.free_flow_speed_kmh AS cost, s.segment_id AS path, 1 AS len
  FROM segments b JOIN segments s ON s.source_node = b.source_node AND s.segment_id <> b.segment_id, (VALUES ('peak'), ('offpeak')) k(bucket)
  UNION ALL
  SELECT w.bucket, w.blocked_id, w.goal, s.segment_id, s.target_node, w.cost + s.length_km / s.free_flow_speed_kmh, w.path || ',' || s.segment_id, w.len + 1
  FROM w JOIN turns t ON t.from_segment = w.segment_id AND t.bucket = w.bucket JOIN segments s ON s.segment_id = t.to_segment
  WHERE w.at_node <> w.goal AND s.segment_id <> w.blocked_id AND w.len < 7 AND position(s.segment_id IN w.path) = 0) SELECT * FROM w)"""
WAY = """
SELECT bucket, blocked_id, min(cost) AS cost_hours, arg_min(len, (cost, path)) AS turns, replace(arg_min(path, (cost, path)), ',', '>') AS path
FROM ways WHERE at_node = goal GROUP BY ALL"""
query("detours", "bucket:s blocked_id:s cost_hours:d turns:i path:s", "SELECT * FROM way", ways=WAYS, way=WAY)(
    lambda c: c.detours.withColumns({"turns": F.size("path"), "path": F.concat_ws(">", "path")}))
query("segment_geometry", "segment_id:s lon1:d lat1:d lon2:d lat2:d", """
SELECT segment_id, a.lon + ox AS lon1, a.lat + oy AS lat1, b.lon + ox AS lon2, b.lat + oy AS lat2 FROM (
  SELECT s.segment_id, a, b, -(b.lat - a.lat) / n * 0.0012::DOUBLE AS ox, (b.lon - a.lon) / n * 0.0012::DOUBLE AS oy
  FROM (SELECT *, sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) AS n FROM (
    SELECT g.segment_id, a, b FROM segments g JOIN nodes a ON a.node_id = g.source_node JOIN nodes b ON b.node_id = g.target_node)) s)""")(
    lambda c: graph.geometry(c.segments, c.nodes))

# ---- features
_T = ("speed", "flow", "congestion")
_C = {"speed": "speed_kmh", "flow": "flow_vph", "congestion": "congestion_index"}


def _history_sql() -> str:
    out = []
    for m in _T:
        x = _C[m]
        out += [f"lag({x}, {k}) OVER w AS {m}_lag{k}" for k in (1, 3, 6, 12)]
        out += [f"avg({x}) OVER (PARTITION BY segment_id ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {m}_roll{k}"
                for k in (3, 6, 12)]
        out += [f"{x} - lag({x}, 3) OVER w AS {m}_slope3", f"lag({x}, 3) OVER w AS {m}_yday_at_target"]
    out.append("queue_length_veh - lag(queue_length_veh, 3) OVER w AS queue_slope3")
    return f"SELECT segment_id, ts, {', '.join(out)} FROM panel WINDOW w AS (PARTITION BY segment_id ORDER BY ts)"


_HISTORY = " ".join(f"{m}_{s}:d" for m in _T for s in ("lag1", "lag3", "lag6", "lag12", "roll3", "roll6", "roll12", "slope3", "yday_at_target"))
query("lag_features", f"segment_id:s ts:t {_HISTORY} queue_slope3:d", _history_sql())(
    lambda c: features.time_features(c.panel, c.cfg, 1))
query("clock_context_features", "ts:t hour:d hour_sin:d hour_cos:d target_hour_sin:d target_hour_cos:d dow:d weekend:d holiday:d rain:d "
      "temperature:d event_present:d", """
SELECT t.ts, hour(t.ts) AS hour, sin(hour(t.ts) * 2 * pi() / 24) AS hour_sin, cos(hour(t.ts) * 2 * pi() / 24) AS hour_cos,
  sin((hour(t.ts) + 6) * 2 * pi() / 24) AS target_hour_sin, cos((hour(t.ts) + 6) * 2 * pi() / 24) AS target_hour_cos,
  isodow(t.ts) - 1 AS dow, CASE WHEN isodow(t.ts) >= 6 THEN 1 ELSE 0 END AS weekend, holiday_flag AS holiday, rain_intensity AS rain,
  temperature_c AS temperature, CASE WHEN event_level > 0 THEN 1 ELSE 0 END AS event_present
FROM (SELECT DISTINCT ts FROM readings) t JOIN context USING (ts)""")(
    lambda c: features.context_features(features.clock_features(c.readings.select("ts").distinct(), c.cfg, 1), c.context))
query("static_features", "segment_id:s arterial:d lanes:d capacity:d ff_speed:d length:d grade:d signalized:d importance:d", """
SELECT segment_id, CASE WHEN road_class = 'arterial' THEN 1 ELSE 0 END AS arterial, lanes, capacity_vph AS capacity,
  free_flow_speed_kmh AS ff_speed, length_km AS length, grade_pct AS grade, CASE WHEN signal_id IS NOT NULL THEN 1 ELSE 0 END AS signalized,
  importance FROM segments""")(lambda c: features.static_features(c.segments))
query("utilisation_ratios", "segment_id:s ts:t vc_now:d sr_now:d",
      "SELECT segment_id, ts, flow_ratio AS vc_now, speed_ratio AS sr_now FROM ratios")(
    lambda c: features.with_ratios(c.panel, c.segments).select("segment_id", "ts", F.col("flow_ratio").alias("vc_now"),
                                                              F.col("speed_ratio").alias("sr_now")))
query("future_labels", "segment_id:s ts:t target_speed:d delta_speed:d target_flow:d delta_flow:d target_congestion:d delta_congestion:d", """
SELECT segment_id, ts, lead(speed_kmh, 2) OVER w AS target_speed, lead(speed_kmh, 2) OVER w - speed_kmh AS delta_speed,
  lead(flow_vph, 2) OVER w AS target_flow, lead(flow_vph, 2) OVER w - flow_vph AS delta_flow,
  lead(congestion_index, 2) OVER w AS target_congestion, lead(congestion_index, 2) OVER w - congestion_index AS delta_congestion
FROM panel WINDOW w AS (PARTITION BY segment_id ORDER BY ts)""")(lambda c: features.labels(c.panel, c.cfg, 2))
_BESIDE = """
SELECT e.segment_id, n.ts,
  avg(coalesce(n.congestion_index, 0)) FILTER (direction = 'upstream') AS up_congestion,
  avg(coalesce(n.congestion_index, 0)) FILTER (direction = 'downstream') AS down_congestion,
  avg(coalesce(n.speed_ratio, 1)) FILTER (direction = 'upstream') AS up_sr,
  avg(coalesce(n.speed_ratio, 1)) FILTER (direction = 'downstream') AS down_sr,
  avg(coalesce(n.flow_vph, 0)) FILTER (direction = 'upstream') AS up_flow
FROM edges e JOIN ratios n ON n.segment_id = e.neighbor_id GROUP BY ALL"""
_FEATURES = features.feature_names(SIX_HOURLY)
_FILLED = {**{f"{m}_now": f"r.{_C[m]}" for m in _T}, "occupancy_now": "r.occupancy_pct", "queue_now": "r.queue_length_veh", "delay_now": "r.delay_min", "vc_now": "r.flow_ratio", "sr_now": "r.speed_ratio",
           **{n: f"coalesce(b.{n}, 0)" for n in ("up_congestion", "down_congestion", "up_sr", "down_sr", "up_flow")},
           "hour": "hour(r.ts)", "hour_sin": "sin(hour(r.ts) * 2 * pi() / 24)", "hour_cos": "cos(hour(r.ts) * 2 * pi() / 24)", "target_hour_sin": "sin((hour(r.ts) + 6) * 2 * pi() / 24)",
           "target_hour_cos": "cos((hour(r.ts) + 6) * 2 * pi() / 24)", "dow": "isodow(r.ts) - 1", "weekend": "CASE WHEN isodow(r.ts) >= 6 THEN 1 ELSE 0 END",
           "holiday": "coalesce(x.holiday_flag, 0)", "rain": "coalesce(x.rain_intensity, 0)", "temperature": "coalesce(x.temperature_c, (SELECT avg(temperature_c) FROM context))",
           "event_present": "CASE WHEN coalesce(x.event_level, 0) > 0 THEN 1 ELSE 0 END", "arterial": "CASE WHEN s.road_class = 'arterial' THEN 1 ELSE 0 END", "lanes": "s.lanes",
           "capacity": "s.capacity_vph", "ff_speed": "s.free_flow_speed_kmh", "length": "s.length_km", "grade": "s.grade_pct", "signalized": "CASE WHEN s.signal_id IS NOT NULL THEN 1 ELSE 0 END",
           "importance": "s.importance"}
_MATRIX = "SELECT r.segment_id, r.ts, " + ", ".join(f"CAST({_FILLED.get(n, 'h.' + n)} AS DOUBLE) AS {n}" for n in _FEATURES) + """
FROM ratios r JOIN history h ON h.segment_id = r.segment_id AND h.ts = r.ts JOIN segments s ON s.segment_id = r.segment_id LEFT JOIN context x ON x.ts = r.ts
LEFT JOIN beside b ON b.segment_id = r.segment_id AND b.ts = r.ts"""
query("feature_matrix", "segment_id:s ts:t n_features:i n_missing:i " + " ".join(f"{n}:d" for n in _FEATURES),
      f"SELECT *, {len(_FEATURES)} AS n_features, " + " + ".join(f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in _FEATURES) + " AS n_missing FROM matrix",
      matrix=_MATRIX, history=_history_sql(), beside=_BESIDE)(lambda c: _matrix(c))


def _matrix(c):
    """What the model sees: every element of the assembled vectors, by the name of its feature."""
    from pyspark.ml.functions import vector_to_array
    rows = features.as_vectors(features.build(c.panel, c.segments, c.context, c.edges, c.cfg, 1), c.cfg)
    rows = rows.select("segment_id", "ts", vector_to_array("features").alias("v"))
    present = {n: F.when(~F.isnan(F.col("v")[i]), F.col("v")[i]) for i, n in enumerate(features.feature_names(c.cfg))}
    return rows.select("segment_id", "ts", F.size("v").alias("n_features"), F.size(F.filter("v", F.isnan)).alias("n_missing"), *[x.alias(n) for n, x in present.items()])
