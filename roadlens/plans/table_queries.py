"""Queries over sources, profiling and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import slots
from ..operators import graph, quality
from ..sources import routing, tables
from ..sources.workspace import fresh_path, written
from .corridor_queries import GEO
from .registry import query

# ---- sources and sinks
_DAILY = """
SELECT segment_id, CAST(ts AS DATE) AS day, count(*) AS rows, sum(flow_vph) AS flow, sum(occupancy_pct) AS occupancy FROM readings GROUP BY ALL"""


def _csv_roundtrip(c):
    """Readings to CSV, back with the declared schema, on to Parquet, and summed up from there."""
    raw, clean = fresh_path(c.spark, "csv"), fresh_path(c.spark, "parquet")
    blank = F.lit(None).cast("double")
    out = c.readings.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "segment_id", F.lit("a").alias("source_node"), F.lit("b").alias("target_node"),
                            "speed_kmh", "flow_vph", "occupancy_pct", blank.alias("travel_time_min"), blank.alias("free_flow_time_min"), "delay_min", "queue_length_veh",
                            "congestion_index", "sensor_quality")
    out.write.option("header", True).csv(raw)
    tables.write_parquet(tables.read_csv(c.spark, raw, "traffic_train"), clean)
    return c.spark.read.parquet(clean).groupBy("segment_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("rows"), F.sum("flow_vph").alias("flow"), F.sum("occupancy_pct").alias("occupancy"))


query("csv_to_parquet", "segment_id:s day:s rows:i flow:d occupancy:d", _DAILY.replace("CAST(ts AS DATE) AS day", "CAST(CAST(ts AS DATE) AS VARCHAR) AS day"))(
    lambda c: _csv_roundtrip(c).withColumn("day", F.col("day").cast("string")))


_FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _registered(c):
    """Registering twice replaces the views; every file is counted through its view."""
    for _ in range(2):
        tables.register(c.spark, c.sf_dir, _FILES)
    return quality.union_all(c.spark.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in _FILES)


query("register_tables", "table:s rows:i", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in _FILES))(_registered)


def _allowed(c):
    c.roadworks.createOrReplaceTempView("roadworks_train")
    return tables.table(c.spark, "roadworks_train")


query("named_table", "work_id:s segment_id:s start_time:t end_time:t closure_fraction:d", "SELECT work_id, segment_id, start_time, end_time, closure_fraction FROM roadworks")(_allowed)


def _written_panel(c):
    from ..operators import panel
    path = fresh_path(c.spark, "panel-by-date")
    panel.write_panel(c.panel, path, c.cfg, c.n_segments)
    return panel.read_panel(c.spark, path, "2024-01-10 06:00:00", "2024-01-12 12:00:00")


query("panel_by_date", "segment_id:s ts:t speed_kmh:d valid:b quality:d", """
SELECT segment_id, ts, speed_kmh, valid, quality FROM panel WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")(_written_panel)
_NETWORK_COLUMNS = "segment_id, source_node, target_node, road_class, lanes, free_flow_speed_kmh, capacity_vph, length_km, grade_pct, importance, signal_id, structural_bottleneck, peak_capacity_factor"
_OTHER = _NETWORK_COLUMNS.replace(" lanes,", " lanes + structural_bottleneck AS lanes,")
_DIFFERING = f"""(SELECT count(*) FROM (SELECT {_NETWORK_COLUMNS} FROM segments EXCEPT SELECT {_OTHER} FROM segments))
  + (SELECT count(*) FROM (SELECT {_OTHER} FROM segments EXCEPT SELECT {_NETWORK_COLUMNS} FROM segments))"""


def _other_network(c):
    """The city with one more lane on its structural bottlenecks: what a split from another network looks like."""
    return c.segments.withColumn("lanes", F.col("lanes") + F.col("structural_bottleneck"))


query("same_network_check", "network:s differing_rows:i", f"""
SELECT 'own' AS network, 0 AS differing_rows UNION ALL SELECT 'other', {_DIFFERING}""")(
    lambda c: tables.network_difference(c.segments, c.segments).withColumn("network", F.lit("own")).unionByName(
        tables.network_difference(c.segments, _other_network(c)).withColumn("network", F.lit("other"))))


def _imported(c):
    """Both splits are imported, the later one twice; then a split that belongs to another network comes along."""
    root = fresh_path(c.spark, "imported")
    same = {"segments": (c.segments, c.segments), "nodes": (c.nodes, c.nodes)}
    early, late = c.up_to(c.readings, c.cfg.train_end), c.readings.filter(F.col("ts") > slots.at(c.cfg.train_end))
    reports = [tables.import_split(root, "train", early, same, c.cfg)]
    tables.import_split(root, "validation", late, same, c.cfg)
    reports.append(tables.import_split(root, "validation", late, same, c.cfg))
    reports.append(tables.import_split(root, "other", late, {**same, "segments": (c.segments, _other_network(c))}, c.cfg))
    there = tables.splits(c.spark, root)
    sums = there.groupBy("split").agg(F.count("*").alias("stored"), F.sum("ingest_seq").alias("check_sum"))
    report = reduce(DataFrame.unionByName, reports)
    return report.join(tables.overlapping_splits(there), "split", "left").join(sums, "split", "left")


query("import_splits", "split:s status:s rows:i differing_rows:i first:t last:t overlaps:b stored:i check_sum:i", f"""
SELECT *, rows AS stored FROM (SELECT CASE WHEN ts <= TIMESTAMP '2024-01-24 18:00:00' THEN 'train' ELSE 'validation' END AS split, 'imported' AS status, count(*) AS rows, 0 AS differing_rows,
  min(ts) AS first, max(ts) AS last, false AS overlaps, sum(ingest_seq) AS check_sum FROM readings GROUP BY 1)
UNION ALL SELECT 'other', 'refused', 0, {_DIFFERING}, NULL, NULL, NULL, NULL, NULL""")(_imported)


def _checksums(c):
    now = tables.checksums(c.spark, c.sf_dir)
    stored = now.filter("file <> 'part.parquet'").withColumn("sha256", F.when(F.col("file") == "nation.parquet", "0").otherwise(F.col("sha256")))
    return now.join(tables.changed_files(now, stored), "file", "left")


query("file_checksums", "file:s sha256:s bytes:i status:s")(_checksums)
query("dataset_inspection", "column:s missing_pct:d distinct:i roles:s", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", (1 - count({n}) / count(*)) * 100 AS missing_pct, count(DISTINCT {n}) AS distinct, '{r}' AS roles FROM readings"
    for n, r in (("ts", "timestamp"), ("segment_id", "road_id"), ("ingest_seq", ""), ("speed_kmh", "speed"), ("flow_vph", "flow"), ("occupancy_pct", ""), ("delay_min", "delay"),
                 ("queue_length_veh", ""), ("congestion_index", ""), ("sensor_quality", ""))))(lambda c: quality.inspect(c.readings))
query("geojson_lines", "segment_id:s feature:s")(
    lambda c: graph.geojson_features(graph.geometry(c.segments, c.nodes)).select(F.get_json_object("value", "$.properties.segment_id").alias("segment_id"),
                                                                                 F.col("value").alias("feature")))


# ---- provider responses: the routes as routing JSON, parsed back
def _responses(c):
    piece = F.struct(
        F.when(F.col("seq") % 4 != 3, F.concat(F.lit("Road "), F.col("route_id"), F.lit("-"), F.col("seq").cast("string"))).otherwise("").alias("name"),
        F.col("piece_m").alias("distance"),
        F.array(F.struct(F.array("lon", "lat").alias("location"), F.transform(F.sequence(F.lit(1), (F.col("seq") + 1).cast("int")), lambda i: i * 60).alias("bearings"))).alias("intersections"))
    rows = c.pieces.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", piece.alias("step"), "lon", "lat"))).alias("s"), F.max("end_m").alias("total_m"))
    route = F.struct(F.col("total_m").alias("distance"), (F.col("total_m") / 500 * 60).alias("duration"),
                     F.struct(F.transform("s", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"),
                     F.array(F.struct(F.transform("s", lambda p: p["step"]).alias("steps"))).alias("legs"))
    return rows.select(F.col("route_id").alias("request_id"), F.to_json(F.struct(F.lit("Ok").alias("code"), F.array(route).alias("routes"))).alias("body"))


query("parsed_routes", "request_id:s distance_km:d duration_min:d", "SELECT route_id AS request_id, total_m / 1000 AS distance_km, total_m / 500 AS duration_min FROM totals", **GEO)(
    lambda c: routing.route_table(routing.parsed(_responses(c))))
query("parsed_roads", "request_id:s name:s start_m:d end_m:d", """
SELECT route_id AS request_id, 'Road ' || route_id || '-' || CAST(seq AS VARCHAR) AS name, start_m, end_m FROM pieces WHERE seq % 4 <> 3""", **GEO)(
    lambda c: routing.road_table(routing.steps(routing.parsed(_responses(c)))))
query("parsed_junctions", "request_id:s lat:d lon:d", "SELECT route_id AS request_id, round_even(lat, 5) AS lat, round_even(lon, 5) AS lon FROM pieces WHERE seq + 1 >= 3", **GEO)(
    lambda c: routing.junction_table(routing.steps(routing.parsed(_responses(c)))))


def _elements(c):
    tags = F.create_map(*[x for k, v in {
        "name": F.col("name"), "amenity": F.when(F.col("category").isin("hospital", "fuel", "parking"), F.col("category")).when(F.col("category") == "food", "restaurant"),
        "highway": F.when(F.col("category") == "bus", "bus_stop"), "railway": F.when(F.col("category") == "metro", "station"),
        "station": F.when(F.col("category") == "metro", "subway"), "addr:street": F.lit("Main"), "addr:housenumber": F.col("poi_id")}.items() for x in (F.lit(k), v)])
    number = F.substring("poi_id", 2, 20).cast("long")
    centred = number % 2 == 1
    body = F.to_json(F.struct(F.lit("node").alias("type"), number.alias("id"), F.when(~centred, F.col("lat")).alias("lat"), F.when(~centred, F.col("lon")).alias("lon"),
                              F.when(centred, F.struct("lat", "lon")).alias("center"), tags.alias("tags")))
    once = c.pois.select(body.alias("body"))
    return once.unionByName(once)


query("normalised_places", "poi_id:s category:s name:s lat:d lon:d address:s", "SELECT poi_id, category, name, lat, lon, poi_id || ' Main' AS address FROM pois")(
    lambda c: routing.places(_elements(c)))

# ---- profiles
_COLS = {"readings": ("ts:t segment_id:s ingest_seq:n speed_kmh:n flow_vph:n occupancy_pct:n delay_min:n queue_length_veh:n congestion_index:n sensor_quality:n"),
         "nodes": "node_id:n x:g y:g lat:g lon:g", "roadworks": "work_id:s segment_id:s start_time:t end_time:t closure_fraction:n work_type:s",
         "segments": "segment_id:s source_node:n target_node:n road_class:s lanes:n free_flow_speed_kmh:n capacity_vph:n length_km:n grade_pct:s importance:n signal_id:s structural_bottleneck:n "
                     "peak_capacity_factor:n",
         "signals": "signal_id:s node_id:n cycle_s:n green_ratio:n", "turn_restrictions": "node_id:n from_segment:s to_segment:s restriction:s",
         "incidents": "incident_id:s segment_id:s start_time:t end_time:t incident_type:s severity:n lanes_blocked:n",
         "context": "ts:t temperature_c:n rain_intensity:n event_level:n holiday_flag:n", "od_demand": "origin_node:n destination_node:n base_demand_vph:n",
         "candidates": "candidate_id:s target_segment:s intervention_type:s capacity_delta_vph:n cost_index:n feasibility_band:s", "pois": "poi_id:s name:s category:s lat:g lon:g"}


def _profile_sql() -> str:
    out = []
    for t, spec in _COLS.items():
        out.append(f"SELECT '{t}' AS dataset, '' AS \"column\", 'rows' AS metric, count(*)::DOUBLE AS value FROM {t}")
        for item in spec.split():
            n, k = item.split(":")
            out.append(f"SELECT '{t}', '{n}', 'nulls', count(*) FILTER ({n} IS NULL) FROM {t}")
            if k == "n":
                out.append(f"SELECT '{t}', '{n}', 'negatives', count(*) FILTER ({n} < 0) FROM {t}")
            if k in "tg":
                v = f"floor(epoch_us({n}) / 1000000)" if k == "t" else n
                out += [f"SELECT '{t}', '{n}', '{f}', {f}({v})::DOUBLE FROM {t}" for f in ("min", "max")]
    return " UNION ALL ".join(out)


query("profile_long", "dataset:s column:s metric:s value:d", _profile_sql())(
    lambda c: quality.union_all(quality.profile(getattr(c, name).select(*[x.split(":")[0] for x in spec.split()]), name) for name, spec in _COLS.items()))
query("duplicate_rows", "dataset:s duplicates:i", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS duplicates FROM {n}" for n in ("readings", "incidents", "roadworks", "candidates", "segments")))(
    lambda c: quality.union_all(quality.duplicate_rows(getattr(c, n), n) for n in ("readings", "incidents", "roadworks", "candidates", "segments")))
_NUM = ("speed_kmh", "flow_vph", "occupancy_pct", "delay_min", "queue_length_veh", "congestion_index", "sensor_quality")
query("numeric_stats", "column:s min:d max:d mean:d median:d stddev:d distinct:i nulls:i", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", min({n}) AS min, max({n}) AS max, avg({n}) AS mean, median({n}) AS median, stddev_pop({n}) AS stddev, count(DISTINCT {n}) AS distinct, "
    f"count(*) FILTER ({n} IS NULL) AS nulls FROM readings" for n in _NUM))(lambda c: quality.numeric_stats(c.readings, _NUM))
query("categorical_profile", "column:s distinct:i values:s", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) AS distinct, CASE WHEN count(DISTINCT {n}) <= 15 THEN string_agg(DISTINCT {n}, ',' ORDER BY {n}) END AS values FROM incidents"
    for n in ("incident_id", "incident_type")))(
    lambda c: quality.categories(c.incidents, ["incident_id", "incident_type"]).withColumn("values", F.when(F.col("values").isNotNull(), F.concat_ws(",", "values"))))
_DOMAINS = (("candidates", ("intervention_type", "feasibility_band")), ("incidents", ("incident_type",)), ("roadworks", ("work_type",)), ("segments", ("road_class",)),
            ("turn_restrictions", ("restriction",)))
query("domain_listing", "dataset:s column:s value:s rows:i", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{n}' AS \"column\", CAST({n} AS VARCHAR) AS value, count(*) AS rows FROM {t} WHERE {n} IS NOT NULL GROUP BY {n}" for t, ns in _DOMAINS for n in ns))(
    lambda c: quality.union_all(quality.value_listing(getattr(c, t), t, ns) for t, ns in _DOMAINS))

# ---- validation
_FKS = (("readings", "segment_id", "segments", "segment_id"), ("incidents", "segment_id", "segments", "segment_id"), ("roadworks", "segment_id", "segments", "segment_id"),
        ("candidates", "target_segment", "segments", "segment_id"), ("segments", "source_node", "nodes", "node_id"), ("segments", "target_node", "nodes", "node_id"),
        ("segments", "signal_id", "signals", "signal_id"), ("signals", "node_id", "nodes", "node_id"), ("turn_restrictions", "node_id", "nodes", "node_id"),
        ("turn_restrictions", "from_segment", "segments", "segment_id"), ("turn_restrictions", "to_segment", "segments", "segment_id"),
        ("od_demand", "origin_node", "nodes", "node_id"), ("od_demand", "destination_node", "nodes", "node_id"))
_ORPHANS = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{col} exists' AS \"check\", count(*) AS original_count, count(*) FILTER ({col} IS NOT NULL AND {col} NOT IN (SELECT {key} FROM {ref} WHERE {key} IS NOT NULL)) AS affected_count FROM {t}"
    for t, col, ref, key in _FKS)


def _orphan_checks(c):
    return [quality.orphans(getattr(c, t), t, col, getattr(c, ref), key) for t, col, ref, key in _FKS]


query("orphans", "dataset:s check:s original_count:i affected_count:i", _ORPHANS)(lambda c: quality.union_all(_orphan_checks(c)))


# rule name -> SQL condition that rows must not meet, by table; both sides read the same conditions
_RULES = {
    "readings": {"negative_measure": "speed_kmh < 0 OR flow_vph < 0 OR occupancy_pct < 0 OR queue_length_veh < 0", "occupancy_over_100": "occupancy_pct > 100"},
    "nodes": {"outside_area": "NOT (lat BETWEEN 17.29 AND 17.47 AND lon BETWEEN 78.34 AND 78.55)", "outside_country": "NOT (lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98)"},
    "incidents": {"ends_before_start": "end_time < start_time"}, "roadworks": {"ends_before_start": "end_time < start_time"}}


def _range_checks(c):
    return [quality.violations(getattr(c, t), t, **{k: F.expr(v) for k, v in rules.items()}) for t, rules in _RULES.items()] + [
        quality.violations(_scenario_examples(c), "scenarios", ends_before_start=F.col("end_time") < F.col("start_time"))]


_RANGES = " UNION ALL ".join([f"SELECT '{t}' AS dataset, '{k}' AS \"check\", count(*) AS original_count, count(*) FILTER ({v}) AS affected_count FROM {t}"
                              for t, rules in _RULES.items() for k, v in rules.items()]
                             + ["SELECT 'scenarios', 'ends_before_start', count(*), count(*) FILTER (end_time < start_time) FROM incidents"])
_FAST = """
SELECT 'readings' AS dataset, 'speed_over_limit' AS "check", count(*) AS original_count, count(*) FILTER (speed_kmh > 1.5::DOUBLE * free_flow_speed_kmh) AS affected_count
FROM readings JOIN segments USING (segment_id)"""


def _speed_rule(c, factor=1.5):
    """Speeds against the segment's free-flow speed."""
    rows = c.readings.join(c.segments.select("segment_id", "free_flow_speed_kmh"), "segment_id")
    return quality.violations(rows, "readings", speed_over_limit=F.col("speed_kmh") > factor * F.col("free_flow_speed_kmh"))


query("range_rules", "dataset:s check:s original_count:i affected_count:i", _RANGES)(lambda c: quality.union_all(_range_checks(c)))
query("speed_rule", "dataset:s check:s original_count:i affected_count:i", _FAST)(_speed_rule)
query("validation_report", "dataset:s check:s original_count:i affected_count:i reason:s transformation:s", f"""
SELECT *, CASE WHEN affected_count > 0 THEN "check" ELSE 'none' END AS reason, CASE WHEN affected_count > 0 THEN 'kept, only marked' ELSE 'n/a' END AS transformation
FROM ({_ORPHANS} UNION ALL {_RANGES} UNION ALL {_FAST})""")(lambda c: quality.validation_report([*_orphan_checks(c), *_range_checks(c), _speed_rule(c)]))
query("stage_parity", "dataset:s source:i processed:i imported:i status:s", """
SELECT 'readings' AS dataset, (SELECT count(*) FROM events) AS source, (SELECT count(*) FROM readings) AS processed, (SELECT count(*) FROM dedup) AS imported,
  CASE WHEN (SELECT count(*) FROM events) = (SELECT count(*) FROM readings) AND (SELECT count(*) FROM readings) = (SELECT count(*) FROM dedup) THEN 'OK' ELSE 'MISMATCH' END AS status
UNION ALL SELECT 'candidates', (SELECT count(*) FROM part), (SELECT count(*) FROM candidates), (SELECT count(*) FROM candidates), 'OK'""")(
    lambda c: quality.parity({"source": {"readings": c.raw("events"), "candidates": c.raw("part")}, "processed": {"readings": c.readings, "candidates": c.candidates},
                              "imported": {"readings": c.raw_cells.filter("copies IS NOT NULL"), "candidates": c.candidates}}))

# ---- time and labels
query("time_gaps", "gap_s:i gaps:i", """
SELECT gap AS gap_s, count(*) AS gaps FROM (SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM (SELECT DISTINCT ts FROM readings))
WHERE gap IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")(lambda c: quality.time_gaps(c.readings))
query("incomplete_slots", "ts:t reporting:i expected:i", """
SELECT * FROM (SELECT ts, count(DISTINCT segment_id) AS reporting, (SELECT count(DISTINCT segment_id) FROM readings) AS expected FROM readings GROUP BY ts) WHERE reporting <> expected""")(
    lambda c: quality.incomplete_slots(c.readings))


def _label_check(c):
    """Each horizon has its own label: the reading that long after, by time. Held against the readings and against the sanitised panel."""
    cells = written(c.raw_cells.filter("copies IS NOT NULL").select("segment_id", "ts", "speed_kmh"), "arrived")
    raw = cells.filter(F.col("speed_kmh").isNotNull())
    anchors = cells.select("segment_id", "ts", F.explode(F.array(*[F.lit(m) for m in c.cfg.horizons])).alias("horizon_min"))
    ahead = anchors.withColumn("at", F.col("ts") + F.make_dt_interval(mins=F.col("horizon_min")))
    labels = ahead.join(raw.select("segment_id", F.col("ts").alias("at"), F.col("speed_kmh").alias("target")).hint("merge"), ["segment_id", "at"]).drop("at")
    value = lambda df, name: df.select(F.lit(name).alias("reference"), "segment_id", "ts", F.col("speed_kmh").alias("value"))
    actual = value(raw, "readings").unionByName(value(c.panel, "panel"))
    return quality.label_check(labels, actual, c.cfg.horizons, ("readings", "panel"))


query("label_check", "horizon_min:i reference:s joined:i exact:i mean_abs_diff:d max_abs_diff:d", " UNION ALL ".join(f"""
SELECT {m} AS horizon_min, '{name}' AS reference, count(*) AS joined, count(*) FILTER (abs(t.speed_kmh - p.speed_kmh) < 0.001) AS exact, avg(abs(t.speed_kmh - p.speed_kmh)) AS mean_abs_diff,
  max(abs(t.speed_kmh - p.speed_kmh)) AS max_abs_diff
FROM dedup a JOIN dedup t ON t.segment_id = a.segment_id AND t.ts = a.ts + INTERVAL {m} MINUTE
JOIN {table} p ON p.segment_id = a.segment_id AND p.ts = a.ts + INTERVAL {m} MINUTE WHERE t.speed_kmh IS NOT NULL{more}"""
    for m in (360, 720, 1080) for name, table, more in (("readings", "dedup", " AND p.speed_kmh IS NOT NULL"), ("panel", "panel", ""))))(_label_check)
query("time_span", "dataset:s first:t last:t distinct:i", "SELECT 'readings' AS dataset, min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS distinct FROM readings")(
    lambda c: quality.time_span(c.readings, "readings"))

# ---- audits
_MIN = "floor(epoch_us(end_time) / 1000000) / 60 - floor(epoch_us(start_time) / 1000000) / 60"


def _by(audit, table, col):
    return f"SELECT '{audit}' AS audit, '{col}=' || CAST({col} AS VARCHAR) AS item, count(*)::DOUBLE AS value FROM {table} GROUP BY {col}"


def _fact(audit, item, expr, table):
    return f"SELECT '{audit}' AS audit, '{item}' AS item, CAST({expr} AS DOUBLE) AS value FROM {table}"


query("incident_audit", "audit:s item:s value:d", " UNION ALL ".join([
    _by("incidents", "inc_train", "incident_type"), _by("incidents", "inc_train", "severity"), _fact("incidents", "rows", "count(*)", "inc_train"),
    _fact("incidents", "duration_avg", f"avg({_MIN})", "inc_train"), _fact("incidents", "duration_min", f"min({_MIN})", "inc_train"), _fact("incidents", "duration_max", f"max({_MIN})", "inc_train"),
    _fact("incidents", "segments", "count(DISTINCT segment_id)", "inc_train"),
    _fact("incidents", "segments_in_both_splits", "count(*)", "(SELECT segment_id FROM inc_train INTERSECT SELECT segment_id FROM inc_val)"),
    _fact("incidents", "unseen_types", "count(*)", "(SELECT DISTINCT incident_type FROM inc_val WHERE incident_type NOT IN (SELECT incident_type FROM inc_train))"),
    _fact("incidents", "overlapping_roadworks", "count(*)", "inc_train i JOIN roadworks r ON i.segment_id = r.segment_id AND i.start_time < r.end_time AND r.start_time < i.end_time")]))(
    lambda c: quality.incident_audit(c.in_train(c.incidents), c.in_validation(c.incidents), c.roadworks))


def _scenario_examples(c):
    return c.incidents.select(F.col("incident_id").alias("scenario_id"), F.col("segment_id").alias("target_segment"), "start_time", "end_time", "incident_type", "severity")


query("scenario_audit", "audit:s item:s value:d", " UNION ALL ".join([
    _by("scenarios", "incidents", "incident_type"), _by("scenarios", "incidents", "severity"), _fact("scenarios", "rows", "count(*)", "incidents"),
    _fact("scenarios", "duration_avg", f"avg({_MIN})", "incidents"), _fact("scenarios", "exact_matches", "count(*)", "inc_train"),
    _fact("scenarios", "on_flagged_segments", "count(*)", "incidents JOIN segments USING (segment_id) WHERE structural_bottleneck = 1"),
    _fact("scenarios", "with_direct_candidate", "count(DISTINCT incident_id)", "incidents JOIN candidates ON target_segment = segment_id")]))(
    lambda c: quality.scenario_audit(_scenario_examples(c), c.in_train(c.incidents), c.segments, c.candidates))
query("network_audit", "audit:s item:s value:d", " UNION ALL ".join([
    _fact("network", "segments", "count(*)", "segments"), _fact("network", "self_loops", "count(*) FILTER (source_node = target_node)", "segments"),
    _fact("network", "duplicate_edges", "count(*) - count(DISTINCT (source_node, target_node))", "segments"),
    _fact("network", "reciprocal_pairs", "floor(count(*) / 2)", "segments a JOIN segments b ON a.source_node = b.target_node AND a.target_node = b.source_node"),
    _by("network", "segments", "road_class"), _by("network", "segments", "lanes"),
    *[f"SELECT 'network' AS audit, '{c} degree ' || CAST(d AS VARCHAR) AS item, count(*)::DOUBLE AS value FROM (SELECT {c}, count(*) AS d FROM segments GROUP BY 1) GROUP BY d"
      for c in ("source_node", "target_node")],
    _fact("network", "isolated_nodes", "count(*)", "nodes WHERE node_id NOT IN (SELECT source_node FROM segments) AND node_id NOT IN (SELECT target_node FROM segments)")]))(
    lambda c: quality.network_audit(c.segments, c.nodes))
_F = "FILTER (structural_bottleneck = 1)"
query("flag_audit", "audit:s item:s value:d", " UNION ALL ".join([
    _fact("flags", "flagged", f"count(*) {_F}", "segments"), *[_fact("flags", f"capacity_{f}", f"{f}(capacity_vph) {_F}", "segments") for f in ("avg", "min", "max")],
    _fact("flags", "importance_avg", f"avg(importance) {_F}", "segments"), _fact("flags", "other_importance_avg", "avg(importance) FILTER (structural_bottleneck = 0)", "segments"),
    _fact("flags", "congestion_flagged", f"avg(congestion_index) {_F}", "readings JOIN segments USING (segment_id)"),
    _fact("flags", "congestion_other", "avg(congestion_index) FILTER (structural_bottleneck = 0)", "readings JOIN segments USING (segment_id)"),
    _fact("flags", "with_direct_candidate", "count(DISTINCT segment_id)", "segments JOIN candidates ON target_segment = segment_id WHERE structural_bottleneck = 1")]))(
    lambda c: quality.flag_audit(c.segments, c.readings, c.candidates))
query("table_audits", "audit:s item:s value:d", " UNION ALL ".join([
    _fact("signals", "plans", "count(*)", "signals"), _fact("signals", "cycle_avg", "avg(cycle_s)", "signals"), _fact("signals", "green_avg", "avg(green_ratio)", "signals"),
    _fact("signals", "signalised_segments", "count(signal_id)", "segments"), _fact("signals", "distinct_ids", "count(DISTINCT signal_id)", "segments"),
    _fact("signals", "unused_plans", "count(*)", "signals WHERE signal_id NOT IN (SELECT signal_id FROM segments WHERE signal_id IS NOT NULL)"),
    _by("turns", "turn_restrictions", "restriction"), _fact("turns", "from_orphans", "count(*)", "turn_restrictions WHERE from_segment NOT IN (SELECT segment_id FROM segments)"),
    _fact("turns", "to_orphans", "count(*)", "turn_restrictions WHERE to_segment NOT IN (SELECT segment_id FROM segments)"),
    _fact("demand", "pairs", "count(*)", "od_demand"), _fact("demand", "origins", "count(DISTINCT origin_node)", "od_demand"),
    _fact("demand", "destinations", "count(DISTINCT destination_node)", "od_demand"), _fact("demand", "total", "sum(base_demand_vph)", "od_demand"),
    _fact("demand", "self_pairs", "count(*) FILTER (origin_node = destination_node)", "od_demand"),
    _by("candidates", "candidates", "intervention_type"), _by("candidates", "candidates", "feasibility_band"), _fact("candidates", "rows", "count(*)", "candidates"),
    _fact("candidates", "targets", "count(DISTINCT target_segment)", "candidates"), _fact("candidates", "cost_avg", "avg(cost_index)", "candidates"),
    _fact("candidates", "targets_with_several", "count(*)", "(SELECT target_segment FROM candidates GROUP BY 1 HAVING count(*) > 1)"),
    _by("context", "context", "holiday_flag"), _by("context", "context", "event_level"), _fact("context", "temperature_avg", "avg(temperature_c)", "context"),
    _fact("context", "rain_max", "max(rain_intensity)", "context"), _by("roadworks", "roadworks", "work_type"), _fact("roadworks", "rows", "count(*)", "roadworks"),
    _fact("roadworks", "closure_avg", "avg(closure_fraction)", "roadworks"), _fact("roadworks", "duration_avg", f"avg({_MIN})", "roadworks")]))(
    lambda c: quality.table_audits(c.segments, c.signals, c.turn_restrictions, c.od_demand, c.candidates, c.context, c.roadworks))
