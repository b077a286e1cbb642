"""Operators on small in-line tables with known answers, and invariants that must hold on any data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadlens.conf import Settings
from roadlens.functions import columns, geo
from roadlens.functions.quantiles import order_bucket, quantiles
from roadlens.operators import compare, corridor, detect, features, forecast, graph, panel, rider, routes, whatif
from roadlens.plans.city import city
from roadlens.sources import tables

SMALL = "/root/testdata/sf0.001"
HOUR = Settings(start="2026-01-01 00:00:00", end="2026-01-01 03:55:00", fit_end="2026-01-01 03:55:00", calib_start="2026-01-01 00:00:00",
                train_end="2026-01-01 03:55:00", val_start="2026-01-01 00:00:00", val_end="2026-01-01 03:55:00")
COLS = "segment_id string, ts timestamp, ingest_seq long, speed_kmh double, flow_vph double, occupancy_pct double, delay_min double, queue_length_veh double, congestion_index double, sensor_quality double"


def at(minutes):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)


def readings(n_segments=3, n_slots=48):
    rng = random.Random(1)
    return [(f"R{s}", at(5 * t), s * 1000 + t, 30 + rng.random() * 10, 500 + rng.random() * 100, 10 + rng.random(), 0.1, 1.0, 0.2, 1.0)
            for s in range(n_segments) for t in range(n_slots)]


@pytest.fixture(scope="module")
def segs(spark):
    return spark.createDataFrame([(f"R{s}", 50.0, 1000.0) for s in range(3)], "segment_id string, free_flow_speed_kmh double, capacity_vph double")


def test_states_including_missing(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([.95, .8, .6, .3, None])], "i int, r double")
    assert [x.s for x in df.select("i", columns.state_of("r").alias("s")).orderBy("i").collect()] == ["NORMAL", "MODERATE", "HEAVY", "CRITICAL", "NO_DATA"]


def test_duplicates_and_negatives_are_removed(spark, segs):
    rows = readings()
    rng = random.Random(2)
    copies = [r[:2] + (r[2] + 100_000,) + (r[3] + 5,) + r[4:] for r in rng.sample(rows, 40)]
    bad = {r[2] for r in rng.sample(rows, 10)}
    noisy = [r[:3] + ((-r[3]),) + r[4:] if r[2] in bad else r for r in rows] + copies
    rng.shuffle(noisy)
    rep = panel.report(spark.createDataFrame(noisy, COLS), segs, HOUR).first()
    assert (rep.rows_in, rep.duplicates_removed, rep.negative_cells, rep.missing_cells) == (184, 40, 10, 0)
    clean = {(r[0], r[1]): r[3] for r in rows if r[2] not in bad}
    got = panel.sanitized(spark.createDataFrame(noisy, COLS), segs, HOUR).filter("valid").collect()
    assert len(got) == len(clean) and all(clean[(r.segment_id, r.ts)] == r.speed_kmh for r in got)


def test_stuck_sensor_is_found_but_saturation_is_not(spark, segs):
    rows = readings()
    held = [(r[0], r[1], r[2], 31.0, 555.0, 10.0, *r[6:]) if r[0] == "R1" and 10 <= r[2] % 1000 < 35 else r for r in rows]
    held = [(r[0], r[1], r[2], 31.0, 555.0, 98.0, *r[6:]) if r[0] == "R2" else r for r in held]
    cells = panel.judged(panel.cells(spark.createDataFrame(held, COLS), segs, HOUR))
    assert {r.segment_id: r.n for r in cells.groupBy("segment_id").agg(F.count_if("stuck").alias("n")).collect()} == {"R0": 0, "R1": 22, "R2": 0}
    worst = panel.sanitized(spark.createDataFrame(held, COLS), segs, HOUR).filter("segment_id = 'R1'").agg(F.min("quality")).first()[0]
    assert worst < 0.5


def test_grid_is_complete_and_fill_stops_after_three_slots(spark, segs):
    rows = [r for r in readings() if not (r[0] == "R0" and 10 <= r[2] % 1000 < 20)]
    got = panel.sanitized(spark.createDataFrame(rows, COLS), segs, HOUR)
    assert got.count() == 3 * 48
    gap = got.filter("segment_id = 'R0' AND speed_kmh IS NULL").agg(F.count("*"), F.min("ts")).first()
    assert gap[0] == 7 and gap[1] == at(5 * 13)


def test_features_do_not_see_the_future(spark, segs):
    rows = readings()
    changed = [r[:3] + (1.0, 2.0) + r[5:] if r[1] > at(120) else r for r in rows]
    def built(data):
        p = panel.sanitized(spark.createDataFrame(data, COLS), segs, HOUR)
        return features.time_features(p, HOUR, 3).filter(F.col("ts") <= F.lit(at(120))).orderBy("segment_id", "ts").drop("quality", "valid").collect()
    assert built(rows) == built(changed)


def test_roadworks_are_half_open_and_labels_closed(spark):
    works = spark.createDataFrame([("W1", "R0", at(10), at(20), "x")], "work_id string, segment_id string, start_time timestamp, end_time timestamp, work_type string")
    assert [r.ts for r in detect.active_roadworks(works, HOUR).orderBy("ts").collect()] == [at(10), at(15)]
    assert [r.ts for r in detect.label_mask(works.withColumn("start_time", F.lit(at(7))), HOUR).orderBy("ts").collect()] == [at(10), at(15), at(20)]


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_bucketed_quantiles_equal_the_exact_ones(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, -1.5, 1e9, rng.gauss(0, 1), rng.random() * 1e-6]) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 50, "g string, v double")
    exact = df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(k) for k, p in (("lo", .05), ("mid", .5), ("hi", .99))])
    want = {r.g: (r.lo, r.mid, r.hi) for r in exact.collect()}
    got = {r.g: (r.lo, r.mid, r.hi) for r in quantiles(df, ["g"], "v", {"lo": .05, "mid": .5, "hi": .99}).collect()}
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-9, abs=1e-12)


def test_quantiles_of_a_narrow_range_spread_over_buckets(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (60 + F.col("id") * 1e-6).alias("v"))
    per_bucket = df.groupBy(order_bucket("v").alias("b")).count().agg(F.max("count")).scalar()
    assert df.agg(F.lit(1)).select(per_bucket).first()[0] < 1000
    got = quantiles(df, ["g"], "v", {"mid": .5, "hi": .999}).first()
    assert abs(got.mid - (60 + 99_999.5e-6)) < 1e-9 and abs(got.hi - (60 + 199_799.001e-6)) < 1e-9


def test_weighted_mean_shares_missing_weights(spark):
    df = spark.createDataFrame([(80.0, None, 40.0), (None, None, None)], "a double, b double, c double")
    w = {"a": .5, "b": .3, "c": .5}
    got = df.select(columns.weighted_mean(w).alias("m"), columns.dropped_components(w).alias("d")).collect()
    assert got[0].m == pytest.approx(60) and got[0].d == "b" and got[1].m is None


def vertices(spark, points, route="r"):
    return spark.createDataFrame([(route, i, lat, lon) for i, (lon, lat) in enumerate(points)], "route_id string, seq int, lat double, lon double")


def test_stretches_cover_the_route_and_keep_corners(spark):
    v = vertices(spark, [(78.4, 17.4), (78.4, 17.41), (78.41, 17.41)])
    cut = routes.stretches(v)
    rows = cut.orderBy("idx").collect()
    assert rows[0].from_m == 0 and rows[-1].to_m == pytest.approx(rows[0].total_m) and all(a.to_m == pytest.approx(b.from_m) for a, b in zip(rows, rows[1:]))
    shapes = routes.stretch_shapes(cut, v).select(F.explode("coords").alias("c")).filter("abs(c.lat - 17.41) < 1e-9 AND abs(c.lon - 78.4) < 1e-9")
    assert shapes.count() >= 1
    assert routes.stretches(vertices(spark, [(78.4, 17.4), (78.4, 17.4001)])).count() == 0


def test_samples_represent_the_whole_length(spark):
    v = vertices(spark, [(78.45, 17.4), (78.45 + 1000 / geo.KX, 17.4)])
    got = routes.samples(v).agg(F.sum("ds_m"), F.max("at_m")).first()
    assert got[0] == pytest.approx(1000) and got[1] == pytest.approx(1000)


def test_distance_to_line(spark):
    df = spark.createDataFrame([(50.0, 0.0), (50.0, 30.0), (-40.0, 0.0)], "x double, y double")
    line = [F.lit(float(v)) for v in (0, 0, 100, 0)]
    assert sorted(r[0] for r in df.select(geo.distance_to_line("x", "y", *line)).collect()) == pytest.approx([0, 30, 40])


@pytest.mark.parametrize("severe,heavy,level", [(120, 0, "free_flow"), (360, 0, "severe"), (0, 360, "heavy"), (120, 240, "heavy")])
def test_route_level_needs_enough_road(spark, severe, heavy, level):
    df = spark.createDataFrame([(float(severe), float(heavy), 0.0)], "s double, h double, m double")
    assert df.select(rider.route_level("s", "h", "m")).first()[0] == level


def records(spark, scores):
    return spark.createDataFrame([("r", i, None if s is None else float(s), 300.0 * i, 300.0 * (i + 1), 300.0, len(scores)) for i, s in enumerate(scores)],
                                 "route_id string, idx long, bottleneck_score double, from_m double, to_m double, length_m double, n int")


@pytest.mark.parametrize("scores,zones", [([10., 10, 30, 60, 80, 20, 70, 10, 10, 10, 10, 10], 1), ([20.] * 8, 0), ([80., 80, None, None, 80, 80], 2)])
def test_zones_merge_small_gaps_but_never_missing_data(spark, scores, zones):
    assert corridor.zones(records(spark, scores)).count() == zones


def test_candidate_extents(spark):
    rec = records(spark, [10., 10, 30, 60, 80, 20, 70, 10, 10, 10, 10, 10])
    got = corridor.extents(rec, corridor.zones(rec)).first()
    first = corridor.first_extents(rec, corridor.zones(rec)).first()
    assert got.first_idx <= 3 and got.last_idx >= 6 and got.seeds == 3 and (first.first_idx, first.last_idx) == (got.first_idx, got.last_idx)
    assert got.start_m == 300.0 * got.first_idx - 150
    long = records(spark, [85.] * 20)
    parts = corridor.extents(long, corridor.zones(long)).collect()
    assert len(parts) >= 3 and all(p.end_m - p.start_m <= 2300 for p in parts) and sum(p.seeds for p in parts) == 20


def zone(spark, **over):
    base = dict(zone_id="z", utilization=.9, speed=15.0, ff=40.0, length_km=2.0, signals=2.0, signal_delay_s=30.0, min_lanes=3, junctions=2)
    names = ", ".join(f"{k} {'string' if k == 'zone_id' else 'int' if k in ('min_lanes', 'junctions') else 'double'}" for k in base)
    return spark.createDataFrame([tuple((base | over).values())], names)


def test_impact_grows_with_capacity_and_never_beats_free_flow(spark):
    rows = zone(spark).withColumn("fixed_gain", F.explode(F.array(*[F.lit(g) for g in (0.0, .2, .5, 5.0)]))).withColumns(
        {"gain_cap": F.lit(None).cast("double"), "signal_removal": F.lit(0.0), "demand_shift": F.lit(0.0)})
    got = compare.impact(rows).orderBy("fixed_gain").collect()
    assert [r.speed_after for r in got] == sorted(r.speed_after for r in got) and max(r.speed_after for r in got) <= 40
    assert got[0].speed_before == got[0].speed_after and got[0].congestion_change_pct == 0


@pytest.mark.parametrize("lanes,gain", [(2, 50), (4, 25)])
def test_widening_gain_follows_the_lanes(spark, lanes, gain):
    rows = compare.impact(compare.with_interventions(zone(spark, min_lanes=lanes))).filter("intervention = 'road_widening'")
    assert rows.first().capacity_change_pct == gain


def test_applicability(spark):
    rows = compare.with_applicability(compare.with_interventions(zone(spark, signals=0.0, junctions=0)).withColumn("alt_routes", F.lit(0)))
    assert {r.intervention for r in rows.filter("NOT applicable").collect()} == {"signal_optimization", "junction_redesign", "traffic_diversion"}


def test_more_capacity_never_slows_a_link(spark):
    df = spark.range(0, 4000, 100).select(F.col("id").cast("double").alias("flow"))
    t = lambda cap: whatif.link_hours("flow", F.lit(cap), F.lit(.02), F.lit(90), F.lit(.4))
    assert df.filter((t(2000.0) > t(1800.0)) | (t(2000.0) < 0.02)).count() == 0


def test_detours_are_legal_and_avoid_the_blocked_segment(spark):
    c = city(spark, SMALL)
    legal = c.legal_turns.filter("bucket = 'peak'").drop("bucket")
    ways = graph.detours(c.segments, c.segments, legal)
    assert ways.filter(F.array_contains("path", F.col("blocked_id"))).count() == 0
    assert graph.path_legality(ways.withColumnRenamed("blocked_id", "path_id"), c.segments, legal).filter("NOT legal").count() == 0


def test_unknown_hour_enforces_timed_restrictions(spark):
    r = spark.createDataFrame([("a", "time_window"), ("b", "no_turn")], "from_segment string, restriction string")
    n = lambda h: graph.blocked_turns(r, F.lit(h).cast("int"), HOUR).count()
    assert (n(None), n(8), n(3)) == (2, 2, 1)


def test_panel_ends_at_the_requested_time(spark):
    c = city(spark, SMALL)
    got = panel.as_of(c.panel, "2024-01-26 13:30:00", c.cfg).agg(F.max("ts"), F.countDistinct("ts")).first()
    assert got[0] == dt.datetime(2024, 1, 26, 12) and got[1] == c.cfg.history_slots


def test_only_listed_tables_are_served(spark):
    with pytest.raises(ValueError):
        tables.table(spark, "traffic_train")
    with pytest.raises(ValueError):
        a = spark.createDataFrame([("R1", 2)], "segment_id string, lanes int")
        tables.assert_same_network(a, a.withColumn("lanes", F.lit(3)))


def test_hot_plans_have_no_cartesian_product(spark):
    c = city(spark, SMALL)
    for df in (panel.sanitized(c.readings, c.segments, c.cfg), detect.components(c.ratios, c.baseline, c.edges), routes.match(c.stretches, c.lines),
               graph.neighbor_means(features.with_ratios(c.panel, c.segments), c.edges), whatif.shortlist(c.reach, c.segments, c.candidates)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_feasible_candidate_is_ranked(spark):
    """As many candidates as lie within two hops, however many share a target; the infeasible ones and those farther away are left out."""
    segments = spark.createDataFrame([("A", 1, 2, None), ("B", 2, 3, "S1"), ("C", 3, 1, None)], "segment_id string, source_node long, target_node long, signal_id string")
    reach = spark.createDataFrame([("A", "B", 1, "downstream"), ("A", "C", 3, "downstream")], "segment_id string, reached_id string, hop long, direction string")
    rows = [(f"a{k}", "A", "capacity", 100 * (k - 4), 10 + k, "high") for k in range(9)] + [(f"b{k}", "B", "signal_retiming", 50, 5, "low") for k in range(8)]
    rows += [("a-signal", "A", "signal_retiming", 50, 1, "high"), ("c0", "C", "capacity", 50, 1, "high")]
    candidates = spark.createDataFrame(rows, "candidate_id string, target_segment string, intervention_type string, capacity_delta_vph long, cost_index long, feasibility_band string")
    cases = spark.createDataFrame([("A", at(0), "HEAVY", True)], "segment_id string, ts timestamp, state string, anomalous boolean")
    links = spark.createDataFrame([(s, at(0), 900.0, 1000.0, 0.01, 0, 1.0, 0.02, 0.9, 0.5) for s in "ABC"],
                                  "segment_id string, ts timestamp, flow double, cap double, free_h double, cycle long, green double, time_h double, vc double, length_km double")
    edges = spark.createDataFrame([("A", "B")], "segment_id string, neighbor_id string")
    tried = whatif.within_reach(reach, segments, candidates)
    got = whatif.ranked(whatif.evaluate_candidates(cases, links, edges, tried, candidates, 3)).collect()
    assert {r.candidate_id for r in got} == {f"a{k}" for k in range(9)} | {f"b{k}" for k in range(8)}
    assert sorted(r["rank"] for r in got) == list(range(1, 18)) and all(r.hop == (0 if r.target_segment == "A" else 1) for r in got)


def test_bands_of_every_slot(spark):
    """Unless a sample is asked for, the residuals of all slots of the calibration days count."""
    cfg = HOUR.with_(band_min_rows=1)
    keys = "segment_id string, ts timestamp, metric string, horizon_min long, now double"
    predicted = spark.createDataFrame([("R0", at(5 * t), "speed", 15, 50.0, 50.0) for t in range(40)], keys + ", p50 double")
    actual = spark.createDataFrame([("R0", at(5 * t), "speed", 15, 50.0, 50.0 + (0 if t % 3 == 0 else t)) for t in range(40)], keys + ", actual double")
    ratios = spark.createDataFrame([("R0", at(5 * t), 0.95) for t in range(40)], "segment_id string, ts timestamp, speed_ratio double")
    every, some = [{r.bucket: r for r in forecast.residual_bands(predicted, actual, ratios, cfg, sampled=s).collect()} for s in (False, True)]
    assert (every["normal"].n, some["normal"].n) == (40, 14)
    assert every["normal"].hi > 30 and some["normal"].hi == 0


def test_tasks_of_a_fit_follow_its_rows(spark, monkeypatch):
    """All rows are fitted, in as few tasks as their number asks for: each level of each tree runs a job over all tasks."""
    went = []

    class Fits:
        def __init__(self, stages):
            self.stages = stages

        def fit(self, df):
            went.append((df.rdd.getNumPartitions(), df.count(), self.stages[-1].getMaxIter(), self.stages[-1].getMaxDepth()))
    monkeypatch.setattr(forecast, "Pipeline", Fits)
    cfg = HOUR.with_(fit_every=1, end="2026-01-01 23:55:00", fit_end="2026-01-01 23:55:00")
    rows = spark.createDataFrame([(f"R{s}", at(5 * t), 1.0 if t % 5 else None) for s in range(4) for t in range(100)], "segment_id string, ts timestamp, delta_speed double").repartition(12)
    for per_task in (30_000, 100):
        monkeypatch.setattr(forecast, "ROWS_PER_TASK", per_task)
        forecast.train(rows, "speed", 15, cfg)
    assert went == [(1, 320, 100, 6), (4, 320, 100, 6)]
