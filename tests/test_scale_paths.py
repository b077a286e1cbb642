"""Rank statistics, tiles, periods, detours, imports and scenarios: results against plain computations, and plans that must hold at scale."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import COLS, HOUR, SMALL, at

from roadlens.conf import SIX_HOURLY
from roadlens.functions import columns, slots
from roadlens.functions.quantiles import quantiles, with_counts_below
from roadlens.operators import corridor, features, graph, panel, quality, robustness, whatif
from roadlens.plans.city import city
from roadlens.sources import tables
from roadlens.sources.workspace import bucketed, fresh_path, scratch, written


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_ranks_of_one_key(spark):
    rng = np.random.default_rng(5)
    values = np.round(np.concatenate([rng.normal(0, 1, 4000), rng.lognormal(0, 6, 1000), -rng.lognormal(0, 6, 500), np.zeros(300)]), 6)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = {f"p{k}": k / 97 for k in range(98)}
    got = quantiles(df, [], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_a_rank_is_looked_for_once(spark):
    """Each round starts from the written result of the one before: a task holds the windows of one round."""
    df = spark.createDataFrame([(k, float(v)) for k in range(3) for v in range(50)], "k long, v double")
    found = quantiles(df, ["k"], "v", {"m": 0.5, "h": 0.9})
    assert plan_of(found).count("Window [") <= 2
    assert {(r.k, r.m, round(r.h, 9)) for r in found.collect()} == {(k, 24.5, 44.1) for k in range(3)}


def test_counts_below_every_value(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-3.5, 0.0, 1e-9, 2.0, 2.0000001, 1e12, rng.gauss(0, 5)]), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(400)]
    counted = spark.createDataFrame(rows, "q_value double, p long, q long").groupBy("q_value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    for r in with_counts_below(counted, ["p", "q"]).collect():
        assert r.p_below == sum(p for v, p, _ in rows if v < r.q_value) and r.q_below == sum(q for v, _, q in rows if v < r.q_value)


def test_ranking_with_ties(spark):
    rows = [(0.9, True), (0.9, False), (0.5, True), (0.5, False), (0.5, False), (0.1, False)]
    got = corridor.ranking_quality(spark.createDataFrame(rows, "v double, y boolean"), "v", "y").first()
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in rows for b, yb in rows if ya and not yb]
    assert got.auc == pytest.approx(sum(pairs) / len(pairs)) and got.precision_at_k == pytest.approx(0.5) and got.k == 2


def test_neighbors_move_cells_and_not_edges(spark, no_broadcast):
    c = city(spark, SMALL)
    edges = graph.tiled(graph.neighbors(c.segments), c.segments, c.nodes, c.n_segments, per_tile=10)
    edges = written(edges, "edges")
    assert edges.select("tile").distinct().count() > 3
    values = features.with_ratios(c.panel, c.segments).select("segment_id", "ts", "speed_ratio")
    stat = graph.neighbor_stat(values, edges, [F.max("speed_ratio").alias("m"), F.count("*").alias("n")])
    plain = (graph.neighbors(c.segments).join(values.withColumnRenamed("segment_id", "neighbor_id"), "neighbor_id")
             .groupBy("segment_id", "ts").agg(F.max("speed_ratio").alias("m"), F.count("*").alias("n")))
    assert sorted(map(tuple, stat.collect()), key=str) == sorted(map(tuple, plain.select(stat.columns).collect()), key=str)
    # after the cells have been dealt by tile, neither the join with the edges nor the aggregate moves them again
    above = plan_of(stat).split("REPARTITION_BY_COL")[0]
    assert above.count("Exchange") == 1 and "hashpartitioning(tile" in above


def test_only_asked_periods_are_read(spark):
    c = city(spark, SMALL)
    for df in (panel.as_of(c.dated_panel, c.AS_OF, c.cfg), slots.within(c.dated_components, slots.at(c.AS_OF), slots.at(c.AS_OF), c.cfg)):
        assert re.search(r"PartitionFilters: \[[^]]*period", plan_of(df)) and slots.PERIOD not in df.columns
        assert df.count() > 0
    whole = slots.within(c.dated_panel, None, None, c.cfg)
    assert whole.count() == c.panel.count()


def test_no_detour_out_of_a_dead_end(spark):
    ends = [("a", 1, 2), ("b", 2, 1), ("c", 2, 3), ("d", 3, 2), ("e", 3, 1), ("f", 1, 3), ("g", 3, 4), ("h", 4, 3)]
    segments = spark.createDataFrame([(s, x, y, 1.0 + k / 100, 50.0) for k, (s, x, y) in enumerate(ends)], "segment_id string, source_node long, target_node long, length_km double, free_flow_speed_kmh double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 2.0)], "node_id long, lat double, lon double")
    turns = [(k, a, b) for k in ("peak", "offpeak") for a, _, y in ends for b, x, _ in ends if x == y and not (k == "peak" and (a, b) == ("f", "d"))]
    legal = spark.createDataFrame(turns, "bucket string, from_segment string, to_segment string")
    got = {(r.bucket, r.blocked_id): (r.path, round(r.cost_hours, 9)) for r in graph.detours(segments, segments, legal, nodes).collect()}
    assert got["offpeak", "a"][0] == ["f", "d"] and got["offpeak", "a"][1] == round((1.05 + 1.03) / 50, 9)
    assert ("peak", "a") in got and got["peak", "a"][0] != ["f", "d"]
    assert not {k for k in got if k[1] in ("g", "h")}


def test_import_replaces_only_its_split(spark):
    rows = lambda n, first: spark.createDataFrame([("R0", at(5 * (first + t)), t) for t in range(n)], "segment_id string, ts timestamp, ingest_seq long")
    ours = spark.createDataFrame([("R0", 2), ("R1", 3)], "segment_id string, lanes long")
    root = fresh_path(spark, "import")
    assert tables.import_split(root, "train", rows(9, 0), {"network": (ours, ours)}, HOUR).first().rows == 9
    assert tables.import_split(root, "test", rows(5, 9), {"network": (ours, ours)}, HOUR).first().rows == 5
    assert tables.import_split(root, "test", rows(4, 6), {"network": (ours, ours)}, HOUR).first().rows == 4
    refused = tables.import_split(root, "train", rows(1, 0), {"network": (ours, ours.filter("lanes = 2"))}, HOUR).first()
    assert (refused.status, refused.differing_rows) == ("refused", 1)
    there = tables.splits(spark, root)
    assert {r.split: r["count"] for r in there.groupBy("split").count().collect()} == {"train": 9, "test": 4}
    assert {r.split: r.overlaps for r in tables.overlapping_splits(there).collect()} == {"train": False, "test": True}


def test_corrected_sums_equal_a_whole_recount(spark):
    c = city(spark, SMALL)
    found = whatif.scenario_kpis(c.touched, c.links)
    case = c.touched.filter("time_after <> time_before").orderBy("segment_id", "ts", "candidate_id").first()
    mine = c.touched.filter((F.col("segment_id") == case.segment_id) & (F.col("ts") == F.lit(case.ts)) & (F.col("candidate_id") == case.candidate_id))
    after = (c.links.filter(F.col("ts") == F.lit(case.ts)).join(mine.select(F.col("link_id").alias("segment_id"), "cap_after", "time_after"), "segment_id", "left")
             .withColumns({"time_h": F.coalesce("time_after", "time_h"), "cap": F.coalesce("cap_after", "cap")}).withColumn("vc", F.col("flow") / F.col("cap")))
    want = whatif.network_kpis(after).first()
    got = {r.kpi: r.after for r in found.filter((F.col("segment_id") == case.segment_id) & (F.col("ts") == F.lit(case.ts)) & (F.col("candidate_id") == case.candidate_id)).collect()}
    assert got == pytest.approx({k: want[k] for k in whatif.KPIS}, rel=1e-9)


def test_noise_does_not_depend_on_the_order(spark):
    c = city(spark, SMALL)
    count = lambda df: {r.scenario: (r.n, r.s) for r in df.groupBy("scenario").agg(F.count("*").alias("n"), F.bit_xor("ingest_seq").alias("s")).collect()}
    a, b = (count(robustness.scenario_readings(x, SIX_HOURLY)) for x in (c.readings, c.readings.repartition(13)))
    assert a == b and set(a) == {"clean", *robustness.KINDS}
    clean = a["clean"][0]
    assert 0.9 * clean < a["missing"][0] < clean < a["duplicates"][0] < 1.1 * clean and a["shuffle"][0] == clean


def test_both_pipelines_share_one_noisy_grid(spark):
    readings = spark.createDataFrame([(s, at(5 * t), 100 * k + t, None if t == 2 else 30.0 + t, 100.0 * t, 5.0, 0.0, 0.0, 0.1, 1.0)
                                      for k, s in enumerate(("a", "b")) for t in (0, 1, 1, 2, 4)] + [("a", at(5), 900, 77.0, 9.0, 5.0, 0.0, 0.0, 0.1, 0.1)], COLS)
    segments = spark.createDataFrame([("a", 50.0, 900.0), ("b", 60.0, 900.0), ("c", 60.0, 900.0)], "segment_id string, free_flow_speed_kmh double, capacity_vph double")
    found = robustness.scenario_panels(readings, segments, HOUR, ("shuffle", "combined"))
    # readings meet the grid once, for both pipelines
    assert len(re.findall(r"SortMergeJoin \[segment_id#\d+, ts#", plan_of(found).split("Initial Plan")[-1])) == 1
    noisy = robustness.scenario_readings(readings, HOUR, ("shuffle", "combined"))
    got = sorted(map(str, found.collect()))
    want = []
    for kind in ("clean", "shuffle", "combined"):
        mine = noisy.filter(F.col("scenario") == kind).drop("scenario")
        for name, job in (("sanitized", panel.sanitized), ("naive", panel.naive)):
            want += map(str, job(mine, segments, HOUR).withColumn("segment_id", F.concat(F.lit(f"{name}|{kind}|"), "segment_id")).select(found.columns).collect())
    assert got == sorted(want) and len(got) == 3 * 2 * segments.count() * readings.sparkSession.range(1).select(
        F.size(slots.slot_range(slots.at(HOUR.start), slots.at(HOUR.end), HOUR))).first()[0]


def test_buckets_follow_the_rows(spark):
    """A task takes one bucket of all directories: what it holds must not grow with the table."""
    df = spark.createDataFrame([(f"s{k}", k % 3) for k in range(30)], "segment_id string, week int")
    for by in ((), ("week",)):
        for rows, wanted in ((1, 8), (6_000_000, 24), (36_000_000, 144)):
            table = bucketed(df, "buckets", ["segment_id"], ["segment_id"], rows, by=by)
            found = plan_of(table.groupBy("segment_id").count())
            assert re.search(rf"SelectedBucketsCount: {wanted} out of {wanted}", found) and "Exchange" not in found, (rows, by)
            assert table.count() == 30


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(0.005,), (1.999,), (-0.25,), (12.0,), (None,), (-0.0001,)], "x double")
    assert [r[0] for r in df.select(columns.decimals("x")).collect()] == ["0.01", "2.00", "-0.25", "12.00", None, "0.00"]


def test_scratch_removes_what_is_not_kept(spark):
    with scratch(spark) as keep:
        gone = written(spark.range(5).toDF("a"), "gone")
        stays = keep(gone, "stays")
        with scratch(spark) as inner:
            nested = inner(spark.range(2).toDF("b"), "nested")
        assert nested.count() == 2
    assert stays.count() == 5
    fs = spark._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0]))


def test_checksums_read_files_in_parts(spark, tmp_path):
    files = {"mark_alone": b"\xef\xbb\xbf", "mark": b"\xef\xbb\xbfa\nb", "mark_end": b"\xef\xbb\xbfa\r\nb\n", "ends": b"a\r\n\r\r\n\n", "plain": b"x", "nul": bytes(200_000) + b"\n" + bytes(range(256)) * 3000,
             "text.gz": gzip.compress(b"hi\n" * 9), "a b%20": "ü\n".encode() * 70_000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    # a file longer than this must not be read as one value
    limits = {"spark.sql.files.maxPartitionBytes": "50000", "spark.sql.sources.binaryFile.maxLength": "100"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        found = tables.checksums(spark, str(tmp_path)).collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert {(r.file, r.sha256, r.bytes) for r in found} == {(n, hashlib.sha256(d).hexdigest(), len(d)) for n, d in files.items()}


def test_labels_of_all_horizons_are_checked_in_one_join(spark):
    labels = [("a", at(0), 360, 1.0), ("a", at(0), 720, 2.0), ("a", at(0), 720, 2.0), ("b", at(360), 360, None), ("c", at(0), 360, 5.0)]
    actual = [("readings", "a", at(360), 1.0), ("readings", "a", at(720), 2.5), ("panel", "a", at(720), None), ("panel", "b", at(720), 3.0)]
    found = quality.label_check(spark.createDataFrame(labels, "segment_id string, ts timestamp, horizon_min int, target double"),
                                spark.createDataFrame(actual, "reference string, segment_id string, ts timestamp, value double"), (360, 720, 1080), ("readings", "panel"))
    got = {(r.horizon_min, r.reference): (r.joined, r.exact, r.mean_abs_diff, r.max_abs_diff) for r in found.collect()}
    assert got == {(360, "readings"): (1, 1, 0.0, 0.0), (360, "panel"): (1, 0, None, None), (720, "readings"): (2, 0, 0.5, 0.5), (720, "panel"): (2, 0, None, None),
                   (1080, "readings"): (0, 0, None, None), (1080, "panel"): (0, 0, None, None)}
    # the cells meet once, by a sort and not in the driver's memory
    plan = plan_of(found).split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin [segment_id") == 1 and plan.count("Scan ExistingRDD") == 2


def test_cells_are_not_broadcast(spark):
    readings = spark.createDataFrame([("a", at(0), 1, 30.0, 100.0, 5.0, 0.0, 0.0, 0.1, 1.0)], COLS)
    segments = spark.createDataFrame([("a", 50.0, 900.0)], "segment_id string, free_flow_speed_kmh double, capacity_vph double")
    plan = plan_of(panel.cells(readings, segments, HOUR))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
