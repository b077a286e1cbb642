"""Profiling and validation of tables, as aggregations that combine before every shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import slots
from ..functions.quantiles import counted_quantiles
from ..sources.workspace import written

NOT_SIGNED = ("lat", "lon", "x", "y", "grade_pct")
TIME_COLUMNS = ("timestamp", "ts", "start_time", "end_time")
GEO_COLUMNS = ("lat", "lon", "x", "y")


def numeric_columns(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def union_all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, list(parts))


def _value_counts(df: DataFrame, columns, kind: str) -> DataFrame:
    """(column, value, copies): every distinct value with its count; one pass, combined per task."""
    long = df.select([F.col(c).cast(kind).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("copies"))


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """Long (dataset, column, type, metric, value): rows, nulls, negatives, ranges of time and position columns. One aggregation."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    measures = [("", "", "rows", F.count("*"))]
    for name, kind in kinds.items():
        measures.append((name, kind, "nulls", F.count_if(F.col(name).isNull())))
        if name in numeric_columns(df) and name not in NOT_SIGNED:
            measures.append((name, kind, "negatives", F.count_if(F.col(name) < 0)))
        if name in TIME_COLUMNS or name in GEO_COLUMNS:
            value = F.unix_seconds(F.col(name).cast("timestamp")) if name in TIME_COLUMNS else F.col(name)
            measures += [(name, kind, "min", F.min(value)), (name, kind, "max", F.max(value))]
    one = df.agg(*[m[3].cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.lit(n).alias("metric"), F.col(f"m{i}").alias("value"))
                     for i, (c, k, n, _) in enumerate(measures)])
    return one.select(F.lit(dataset).alias("dataset"), F.inline(rows))


def duplicate_rows(df: DataFrame, dataset: str) -> DataFrame:
    """Rows beyond the first of each fully equal set."""
    return (df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
            .agg(F.lit(dataset).alias("dataset"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates")))


def numeric_stats(df: DataFrame, columns=None) -> DataFrame:
    """(column, min, max, mean, median, stddev, distinct, nulls) with the exact median, whatever the size of the table.

    Everything follows from how often each distinct value occurs, counted and written once.
    """
    columns = list(columns or numeric_columns(df))
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "q_value")
    counted = written(long.groupBy("column", "q_value").agg(F.count("*").alias("q_copies")), "value-counts")
    known = counted.filter(F.col("q_value").isNotNull())
    basic = counted.groupBy("column").agg(
        F.min("q_value").alias("min"), F.max("q_value").alias("max"), F.count("q_value").alias("distinct"),
        (F.sum(F.col("q_value") * F.col("q_copies")) / F.sum(F.when(F.col("q_value").isNotNull(), F.col("q_copies")))).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("q_value").isNull(), F.col("q_copies"))), F.lit(0)).alias("nulls"))
    off = F.col("q_value") - F.col("mean")
    spread = known.join(basic.select("column", "mean"), "column").groupBy("column").agg(
        F.sqrt(F.sum(off * off * F.col("q_copies")) / F.sum("q_copies")).alias("stddev"))
    middle = counted_quantiles(known, ["column"], F.array(F.struct(F.lit("median").alias("name"), F.lit(0.5).alias("p")))).select("column", F.col("quantile").alias("median"))
    return basic.join(spread, "column", "left").join(middle, "column", "left")


def categories(df: DataFrame, columns, most: int | None = 15) -> DataFrame:
    """(column, distinct, values): the sorted value list of columns with at most ``most`` values."""
    counted = _value_counts(df, columns, "string")
    sizes = counted.groupBy("column").agg(F.count("*").alias("distinct"))
    small = sizes if most is None else sizes.filter(F.col("distinct") <= most)
    listed = counted.join(small.select("column"), "column", "left_semi").groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return sizes.join(listed, "column", "left")


def counts_by(df: DataFrame, audit: str, *columns) -> DataFrame:
    """(audit, item, value): rows per value of each column."""
    parts = [df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("value"))
             .select(F.lit(audit).alias("audit"), F.concat(F.lit(f"{c}="), F.coalesce("v", F.lit("null"))).alias("item"), F.col("value").cast("double").alias("value"))
             for c in columns]
    return union_all(parts)


def facts(df: DataFrame, audit: str, **measures: Column) -> DataFrame:
    """(audit, item, value) from named aggregates over one table."""
    names = list(measures)
    one = df.agg(*[measures[n].cast("double").alias(n) for n in names])
    return one.select(F.lit(audit).alias("audit"), F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in names])))


# ---- validation
def orphans(df: DataFrame, dataset: str, column: str, keys: DataFrame, key: str) -> DataFrame:
    """References that point nowhere. NULL references are not orphans. The fact table is reduced to its distinct references first."""
    refs = df.groupBy(F.col(column).alias("ref")).agg(F.count("*").alias("copies"))
    known = keys.select(F.col(key).alias("ref"), F.lit(True).alias("found")).distinct()
    lost = F.col("ref").isNotNull() & F.col("found").isNull()
    return refs.join(known, "ref", "left").agg(
        F.lit(dataset).alias("dataset"), F.lit(f"{column} exists").alias("check"), F.coalesce(F.sum("copies"), F.lit(0)).alias("original_count"),
        F.coalesce(F.sum(F.when(lost, F.col("copies"))), F.lit(0)).alias("affected_count"))


def violations(df: DataFrame, dataset: str, **rules: Column) -> DataFrame:
    """(dataset, check, original_count, affected_count) for rules that rows must not meet; one aggregation for all of them."""
    names = list(rules)
    one = df.agg(F.count("*").alias("original_count"), *[F.count_if(rules[n]).alias(n) for n in names])
    items = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("affected_count")) for n in names])
    return one.select(F.lit(dataset).alias("dataset"), "original_count", F.inline(items)).select("dataset", "check", "original_count", "affected_count")


def validation_report(checks) -> DataFrame:
    bad = F.col("affected_count") > 0
    return union_all(checks).withColumns({"reason": F.when(bad, F.col("check")).otherwise("none"),
                                          "transformation": F.when(bad, "kept, only marked").otherwise("n/a")})


def parity(stages: dict) -> DataFrame:
    """Row counts of one dataset at each stage, and whether they agree. ``stages``: name -> {dataset: DataFrame}."""
    counts = union_all(df.agg(F.lit(dataset).alias("dataset"), F.lit(stage).alias("stage"), F.count("*").alias("rows"))
                       for stage, tables in stages.items() for dataset, df in tables.items())
    wide = counts.groupBy("dataset").pivot("stage", list(stages)).agg(F.first("rows"))
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(next(iter(stages)))) for s in stages])
    return wide.withColumn("status", F.when(same, "OK").otherwise("MISMATCH"))


# ---- time
def time_gaps(df: DataFrame, column: str = "ts", top: int = 5) -> DataFrame:
    """The most frequent distances between consecutive distinct times, in seconds. Distinct times are a small set by nature of the grid;
    they are ordered within each day, and the first time of a day meets the last of the day before by the day index."""
    times = df.select(F.col(column).alias("t")).filter(F.col("t").isNotNull()).distinct().withColumn("day", F.to_date("t"))
    inner = Window.partitionBy("day").orderBy("t")
    days = times.groupBy("day").agg(F.max("t").alias("last"))
    before = days.withColumn("previous_last", F.lag("last").over(Window.orderBy("day"))).select("day", "previous_last")
    gaps = (times.withColumn("prior", F.lag("t").over(inner)).join(before, "day")
            .withColumn("gap_s", F.unix_seconds("t") - F.unix_seconds(F.coalesce("prior", "previous_last"))))
    return gaps.filter(F.col("gap_s").isNotNull()).groupBy("gap_s").agg(F.count("*").alias("gaps")).orderBy(F.col("gaps").desc(), "gap_s").limit(top)


def incomplete_slots(df: DataFrame) -> DataFrame:
    """Slots at which not every segment reported."""
    seen = df.select("ts", "segment_id").distinct()
    per = seen.groupBy("ts").agg(F.count("*").alias("reporting"))
    every = df.agg(F.countDistinct("segment_id")).scalar()
    return per.withColumn("expected", every).filter(F.col("reporting") != F.col("expected"))


def label_check(labels: DataFrame, actual: DataFrame, horizons, references) -> DataFrame:
    """Do the labels (segment_id, ts, horizon_min, target) equal what ``actual`` (reference, segment_id, ts, value) holds that much later?

    One row per horizon and reference, from one join for all of them. Both sides grow with the cells, and the size of their compressed files tells
    little about that, so neither is broadcast.
    """
    later = labels.withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.col("horizon_min")))
    off = F.abs(F.col("target") - F.col("value"))
    found = later.join(actual.hint("merge"), ["segment_id", "ts"]).groupBy("horizon_min", "reference").agg(
        F.count("*").alias("joined"), F.count_if(off < 0.001).alias("exact"), F.avg(off).alias("mean_abs_diff"), F.max(off).alias("max_abs_diff"))
    every = labels.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_min"), F.array(*[F.lit(r) for r in references]).alias("references")) \
        .select("horizon_min", F.explode("references").alias("reference"))
    return every.join(found, ["horizon_min", "reference"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("joined", "exact")})


def value_listing(df: DataFrame, dataset: str, columns) -> DataFrame:
    """(dataset, column, value, rows): every value of categorical columns, one row each, so no list has to fit one row."""
    return _value_counts(df, columns, "string").select(F.lit(dataset).alias("dataset"), "column", "value", F.col("copies").alias("rows"))


def time_span(df: DataFrame, dataset: str, column: str = "ts") -> DataFrame:
    """First, last and number of distinct times."""
    return df.agg(F.lit(dataset).alias("dataset"), F.min(column).alias("first"), F.max(column).alias("last"), F.countDistinct(column).alias("distinct"))


# ---- domain audits
def overlapping(events: DataFrame, works: DataFrame) -> DataFrame:
    """Pairs of one segment whose times overlap. Both sides are listed under the days they touch and met on (segment, day), so a segment
    with a long history pairs only what is close in time; each pair is kept on the first day the two share."""
    def daily(df, start, end):
        return df.withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))

    pairs = daily(events, "start_time", "end_time").join(daily(works, "w_start", "w_end"), ["segment_id", "day"])
    return pairs.filter((F.col("start_time") < F.col("w_end")) & (F.col("w_start") < F.col("end_time"))
                        & (F.col("day") == F.greatest(F.to_date("start_time"), F.to_date("w_start"))))


def incident_audit(train: DataFrame, later: DataFrame, roadworks: DataFrame) -> DataFrame:
    minutes = (F.unix_seconds("end_time") - F.unix_seconds("start_time")) / 60
    both = train.select("segment_id").intersect(later.select("segment_id"))
    unseen = later.select("incident_type").distinct().join(train.select("incident_type").distinct(), "incident_type", "left_anti")
    clash = overlapping(train, roadworks.select("segment_id", F.col("start_time").alias("w_start"), F.col("end_time").alias("w_end")))
    return union_all([
        counts_by(train, "incidents", "incident_type", "severity"),
        facts(train, "incidents", rows=F.count("*"), duration_avg=F.avg(minutes), duration_min=F.min(minutes), duration_max=F.max(minutes),
              segments=F.countDistinct("segment_id")),
        facts(both, "incidents", segments_in_both_splits=F.count("*")), facts(unseen, "incidents", unseen_types=F.count("*")),
        facts(clash, "incidents", overlapping_roadworks=F.count("*"))])


def scenario_audit(scenarios: DataFrame, incidents: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    exact = scenarios.join(incidents.select(F.col("segment_id").alias("target_segment"), "start_time", "end_time", "incident_type"),
                           ["target_segment", "start_time", "end_time", "incident_type"])
    flagged = segments.filter("structural_bottleneck = 1").select(F.col("segment_id").alias("target_segment"))
    direct = scenarios.join(candidates.select("target_segment").distinct(), "target_segment", "left_semi")
    minutes = (F.unix_seconds("end_time") - F.unix_seconds("start_time")) / 60
    return union_all([
        counts_by(scenarios, "scenarios", "incident_type", "severity"), facts(scenarios, "scenarios", rows=F.count("*"), duration_avg=F.avg(minutes)),
        facts(exact, "scenarios", exact_matches=F.count("*")),
        facts(scenarios.join(flagged, "target_segment", "left_semi"), "scenarios", on_flagged_segments=F.count("*")),
        facts(direct, "scenarios", with_direct_candidate=F.countDistinct("scenario_id"))])


def network_audit(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    back = segments.select(F.col("source_node").alias("target_node"), F.col("target_node").alias("source_node"))
    degree = lambda c: (segments.groupBy(c).agg(F.count("*").alias("d")).groupBy("d").agg(F.count("*").cast("double").alias("value"))
                        .select(F.lit("network").alias("audit"), F.concat(F.lit(f"{c} degree "), F.col("d").cast("string")).alias("item"), "value"))
    ends = segments.select(F.col("source_node").alias("node_id")).unionByName(segments.select(F.col("target_node").alias("node_id"))).distinct()
    return union_all([
        facts(segments, "network", segments=F.count("*"), self_loops=F.count_if(F.col("source_node") == F.col("target_node"))),
        facts(segments.groupBy("source_node", "target_node").agg(F.count("*").alias("n")), "network", duplicate_edges=F.coalesce(F.sum(F.col("n") - 1), F.lit(0))),
        facts(segments.join(back, ["source_node", "target_node"]), "network", reciprocal_pairs=F.floor(F.count("*") / 2)),
        counts_by(segments, "network", "road_class", "lanes"), degree("source_node"), degree("target_node"),
        facts(nodes.join(ends, "node_id", "left_anti"), "network", isolated_nodes=F.count("*"))])


def flag_audit(segments: DataFrame, readings: DataFrame, candidates: DataFrame) -> DataFrame:
    flagged = F.col("structural_bottleneck") == 1
    sums = readings.groupBy("segment_id").agg(F.sum("congestion_index").alias("s"), F.count("congestion_index").alias("n"))
    seen = sums.join(segments.select("segment_id", "structural_bottleneck"), "segment_id")
    mean = lambda c: F.sum(F.when(c, F.col("s"))) / F.sum(F.when(c, F.col("n")))
    direct = segments.filter(flagged).join(candidates.select(F.col("target_segment").alias("segment_id")).distinct(), "segment_id", "left_semi")
    when = lambda c: F.when(flagged, F.col(c))
    return union_all([
        facts(segments, "flags", flagged=F.count_if(flagged), capacity_avg=F.avg(when("capacity_vph")), capacity_min=F.min(when("capacity_vph")),
              capacity_max=F.max(when("capacity_vph")), importance_avg=F.avg(when("importance")),
              other_importance_avg=F.avg(F.when(~flagged, F.col("importance")))),
        facts(seen, "flags", congestion_flagged=mean(flagged), congestion_other=mean(~flagged)), facts(direct, "flags", with_direct_candidate=F.count("*"))])


def table_audits(segments: DataFrame, signals: DataFrame, restrictions: DataFrame, od: DataFrame, candidates: DataFrame, context: DataFrame,
                 roadworks: DataFrame) -> DataFrame:
    """Signal, turn, demand, candidate, context and roadwork audits in one long table."""
    unused = signals.join(segments.filter("signal_id IS NOT NULL").select("signal_id").distinct(), "signal_id", "left_anti")
    known = segments.select("segment_id")
    lost = lambda c: restrictions.join(known.withColumnRenamed("segment_id", c), c, "left_anti")
    several = candidates.groupBy("target_segment").agg(F.count("*").alias("n")).filter("n > 1")
    minutes = (F.unix_seconds("end_time") - F.unix_seconds("start_time")) / 60
    return union_all([
        facts(signals, "signals", plans=F.count("*"), cycle_avg=F.avg("cycle_s"), green_avg=F.avg("green_ratio")),
        facts(segments, "signals", signalised_segments=F.count("signal_id"), distinct_ids=F.countDistinct("signal_id")),
        facts(unused, "signals", unused_plans=F.count("*")),
        counts_by(restrictions, "turns", "restriction"), facts(lost("from_segment"), "turns", from_orphans=F.count("*")),
        facts(lost("to_segment"), "turns", to_orphans=F.count("*")),
        facts(od, "demand", pairs=F.count("*"), origins=F.countDistinct("origin_node"), destinations=F.countDistinct("destination_node"),
              total=F.sum("base_demand_vph"), self_pairs=F.count_if(F.col("origin_node") == F.col("destination_node"))),
        counts_by(candidates, "candidates", "intervention_type", "feasibility_band"),
        facts(candidates, "candidates", rows=F.count("*"), targets=F.countDistinct("target_segment"), cost_avg=F.avg("cost_index")),
        facts(several, "candidates", targets_with_several=F.count("*")),
        counts_by(context, "context", "holiday_flag", "event_level"),
        facts(context, "context", temperature_avg=F.avg("temperature_c"), rain_max=F.max("rain_intensity")),
        counts_by(roadworks, "roadworks", "work_type"), facts(roadworks, "roadworks", rows=F.count("*"), closure_avg=F.avg("closure_fraction"), duration_avg=F.avg(minutes))])


# ---- candidate datasets
# Column-name patterns of the roles a column may play.
ROLES = {"latitude": r"^(lat|latitude|y)$|_lat$|^lat_", "longitude": r"^(lon|lng|long|longitude|x)$|_lon$|_lng$|^lon_", "timestamp": r"time|date|ts$",
         "road_id": r"seg|road_id|link|edge|way", "flow": r"flow|volume|count|vph", "speed": r"speed|kmh", "delay": r"delay", "capacity": r"capac", "lanes": r"lane"}
REQUIRED_TARGETS = ("segment_id", "timestamp", "flow_vph", "speed_kmh")


def inspect(df: DataFrame) -> DataFrame:
    """(column, type, missing_pct, distinct, roles) of a dataset that might be imported."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    one = df.agg(F.count("*").alias("n_rows"), *[F.count(F.col(c)).alias(f"has_{i}") for i, c in enumerate(kinds)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(f"has_{i}").alias("present")) for i, (c, k) in enumerate(kinds.items())])
    distinct = _value_counts(df, list(kinds), "string").groupBy("column").agg(F.count("*").alias("distinct"))
    name = F.lower("column")
    roles = F.concat_ws("/", *[F.when(name.rlike(rx), F.lit(role)) for role, rx in ROLES.items()])
    return (one.select("n_rows", F.inline(items)).join(distinct, "column", "left")
            .select("column", "type", (F.when(F.col("n_rows") > 0, 1 - F.col("present") / F.col("n_rows")) * 100).alias("missing_pct"),
                    F.coalesce("distinct", F.lit(0)).alias("distinct"), roles.alias("roles")))


def check_mapping(columns, mapping: dict) -> dict:
    """What a column mapping {theirs: ours} lacks: source columns that are not there, required targets nothing maps to."""
    return {"missing_source": [c for c in mapping if c not in columns],
            "unmapped_targets": [t for t in REQUIRED_TARGETS if t not in set(mapping.values())]}


def apply_mapping(df: DataFrame, mapping: dict) -> DataFrame:
    lacking = check_mapping(df.columns, mapping)
    if any(lacking.values()):
        raise ValueError(f"column mapping is incomplete: {lacking}")
    return df.withColumnsRenamed(mapping)
