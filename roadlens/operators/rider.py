"""Traffic along real routes, for riders: levels, delays, ranking, diversions, alerts, places and plain explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import conf
from ..functions import geo
from ..functions.columns import col, half_even, lookup, state_of
from .routes import near_pairs

SEVERITY = {"severe": 3, "heavy": 2, "moderate": 1}


def level_of(ratio) -> Column:
    return lookup(state_of(ratio), conf.LEVEL_OF_STATE)


def sample_segments(points: DataFrame, lines: DataFrame, radius_m: float = conf.MATCH_RADIUS_M, fallback_m: float = conf.FALLBACK_M) -> DataFrame:
    """The segments that decide the traffic at each sample: all within the radius, and the nearest one within the fallback distance.
    This is geometry only, so it is made once for all slots."""
    pairs = near_pairs(points.select("route_id", "idx", "x", "y"), lines.select("segment_id", "ax", "ay", "bx", "by"), fallback_m)
    order = Window.partitionBy("route_id", "idx").orderBy(F.round("dist_m", 6), "segment_id")
    return (pairs.withColumn("nearest", F.row_number().over(order) == 1).withColumn("inside", F.col("dist_m") <= radius_m)
            .filter(F.col("nearest") | F.col("inside")).select("route_id", "idx", "segment_id", "nearest", "inside", "dist_m"))


def sample_ratios(decided: DataFrame, ratios: DataFrame, columns) -> DataFrame:
    """Worst ratio within the radius, else the nearest one's; one column per entry of ``columns``. ``ratios`` holds (segment_id, ts, ...);
    a segment without data counts as free."""
    free = ratios.select("segment_id", "ts", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in columns])
    return decided.join(free, "segment_id").groupBy("route_id", "idx", "ts").agg(
        *[F.coalesce(F.min(F.when(F.col("inside"), F.col(c))), F.max(F.when(F.col("nearest"), F.col(c)))).alias(c) for c in columns])


def sample_states(points: DataFrame, decided: DataFrame, at_samples: DataFrame, times: DataFrame) -> DataFrame:
    """Every sample at every slot. Samples near a segment (``decided``) have a row per slot in ``at_samples`` already; only the others are laid
    out over the slots, without a ratio. ``times`` is (ts), one row per slot."""
    near = points.join(at_samples, ["route_id", "idx"])
    far = points.join(decided.select("route_id", "idx").distinct(), ["route_id", "idx"], "left_anti") \
        .withColumn("ts", F.explode(times.agg(F.array_sort(F.collect_set("ts"))).scalar()))
    return near.unionByName(far, allowMissingColumns=True)


def delay_minutes(ratio, ds_m, base_kmh) -> Column:
    ratio = col(ratio)
    effective = F.when(ratio.isNull() | (ratio >= conf.FREE_FLOW_RATIO), 1.0).otherwise(F.greatest(ratio, F.lit(conf.MIN_RATIO)))
    return col(ds_m) / 1000 / F.greatest(col(base_kmh), F.lit(conf.MIN_BASE_KMH)) * 60 * (1 / effective - 1)


def sampled_area(nodes: DataFrame, pad: float = 0.009) -> DataFrame:
    return nodes.agg((F.min("lat") - pad).alias("south"), (F.max("lat") + pad).alias("north"), (F.min("lon") - pad).alias("west"),
                     (F.max("lon") + pad).alias("east"))


def assess(states: DataFrame, facts: DataFrame, nodes: DataFrame, now: str = "ratio_now", later: str = "ratio_later") -> DataFrame:
    """Level, delay now and later, coverage and worst point of every route at every slot. ``facts``: (route_id, distance_km, duration_min)."""
    area = sampled_area(nodes)
    edge = {c: area.select(c).scalar() for c in ("south", "north", "west", "east")}
    rows = states.join(facts, "route_id").withColumn("base_kmh", F.col("distance_km") / F.greatest("duration_min", F.lit(0.1)) * 60) \
        .withColumn("level", level_of(now)).withColumns(edge)
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    span = lambda level: F.sum(F.when(F.col("level") == level, F.col("ds_m")).otherwise(0.0))
    place = F.struct("lat", "lon", "level")
    rank = lookup("level", SEVERITY, 0)
    out = rows.groupBy("route_id", "ts").agg(
        span("severe").alias("severe_m"), span("heavy").alias("heavy_m"), span("moderate").alias("moderate_m"),
        F.sum(delay_minutes(now, "ds_m", "base_kmh")).alias("delay_min"), F.sum(delay_minutes(later, "ds_m", "base_kmh")).alias("delay_later_min"),
        (F.sum(F.when(inside, F.col("ds_m")).otherwise(0.0)) / F.greatest(F.sum("ds_m"), F.lit(1.0)) * 100).alias("coverage_pct"),
        F.max(F.struct(rank.alias("rank"), (-F.coalesce(F.round(now, 9), F.lit(1.0))).alias("low"), F.col("idx"), place.alias("at"))).alias("worst"))
    worst = F.when(F.col("worst.rank") >= 2, F.col("worst.at"))
    return out.withColumns({"traffic_level": route_level("severe_m", "heavy_m", "moderate_m"), "worst_lat": worst["lat"], "worst_lon": worst["lon"],
                            "worst_level": worst["level"]}).drop("worst")


def route_level(severe, heavy, moderate, least: float = conf.LEVEL_MIN_M) -> Column:
    """A level counts for the route once it spans enough road."""
    severe, heavy, moderate = col(severe), col(heavy), col(moderate)
    return (F.when(severe >= least, "severe").when(severe + heavy >= least, "heavy").when(severe + heavy + moderate >= least, "moderate")
            .otherwise("free_flow"))


def level_runs(states: DataFrame, now: str = "ratio_now") -> DataFrame:
    """Contiguous runs of one level along each route and slot, with their length."""
    w = Window.partitionBy("route_id", "ts").orderBy("idx")
    rows = states.withColumn("level", level_of(now))
    opens = F.coalesce(F.lag("level").over(w) != F.col("level"), F.lit(True)).cast("int")
    return (rows.withColumn("opens", opens).withColumn("run_no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("route_id", "ts", "run_no").agg(F.first("level").alias("level"), half_even(F.sum("ds_m")).alias("length_m"),
                                                     F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")))


def options(assessed: DataFrame, facts: DataFrame, trips: DataFrame) -> DataFrame:
    """Alternatives of every trip ranked by arrival time, expected worsening and distance."""
    rows = (assessed.join(facts, "route_id").join(trips, "route_id")
            .withColumn("eta", F.col("duration_min") + F.col("delay_min"))
            .withColumn("worsening", F.greatest(F.lit(0.0), F.coalesce("delay_later_min", "delay_min") - F.col("delay_min")))
            .withColumn("expected", F.col("eta") + 0.5 * F.col("worsening"))
            .withColumn("score", F.col("expected") + 0.1 * F.col("distance_km")))
    order = Window.partitionBy("trip_id", "ts").orderBy(F.round("score", 9), F.col("is_default").desc(), "route_id")
    labels = F.array(*[F.lit(x) for x in conf.ROUTE_LABELS])
    return rows.withColumn("ranking", F.row_number().over(order)).withColumns({
        "recommended": F.col("ranking") == 1, "label": F.element_at(labels, F.least("ranking", F.lit(len(conf.ROUTE_LABELS)))),
        "eta_min": half_even("eta"), "delay_rounded": half_even("delay_min"), "worsening_min": half_even("worsening"), "coverage_rounded": half_even("coverage_pct")})


def diversions(ranked: DataFrame, least_saving: float = 2.0) -> DataFrame:
    """Trips whose default route is in trouble and has a clearly better alternative."""
    best = Window.partitionBy("trip_id", "ts").orderBy(F.round("expected", 9), "ranking")
    alternative = (ranked.filter(~F.col("is_default")).withColumn("place", F.row_number().over(best)).filter("place = 1")
                   .select("trip_id", "ts", F.col("route_id").alias("alternative_id"), F.col("expected").alias("alt_expected"),
                           F.col("eta_min").alias("alternative_eta_min"), F.col("traffic_level").alias("alternative_level"),
                           F.col("coverage_rounded").alias("alt_coverage")))
    level = F.col("traffic_level")
    return (ranked.filter("is_default").join(alternative, ["trip_id", "ts"]).withColumn("saving", F.col("expected") - F.col("alt_expected"))
            .filter((level.isin("heavy", "severe") | (F.col("worsening_min") >= 3)) & (F.col("saving") >= least_saving))
            .withColumns({"reason": F.when(level.isin("severe", "heavy"), level).otherwise("worsening"),
                          "confidence": F.when((F.col("saving") >= 5) & (F.least("coverage_rounded", "alt_coverage") >= 40), "Medium").otherwise("Low"),
                          "saving_min": half_even("saving")})
            .select("trip_id", "ts", F.col("route_id").alias("current_id"), "alternative_id", F.col("eta_min").alias("current_eta_min"),
                    "alternative_eta_min", "saving_min", "alternative_level", "confidence", "reason"))


def route_alerts(ranked: DataFrame) -> DataFrame:
    """Alerts on the default route: heavy traffic now, worsening soon."""
    own = ranked.filter("is_default")
    none = F.lit(None).cast("double")
    now = own.filter(F.col("traffic_level").isin("heavy", "severe")).select(
        "trip_id", "ts", "route_id", F.lit("congestion").alias("type"), F.col("traffic_level").alias("severity"), F.col("worst_lat").alias("lat"),
        F.col("worst_lon").alias("lon"))
    soon = own.filter(F.col("worsening_min") >= 2).select("trip_id", "ts", "route_id", F.lit("forecast").alias("type"),
                                                          F.lit("warning").alias("severity"), none.alias("lat"), none.alias("lon"))
    return now.unionByName(soon)


def area_alerts(diagnosed: DataFrame, lines: DataFrame) -> DataFrame:
    """Disruptions in progress (flagged now and heavy or critical), placed at the middle of their segment."""
    middle = lines.select("segment_id", ((F.col("a_lat") + F.col("b_lat")) / 2).alias("lat"), ((F.col("a_lon") + F.col("b_lon")) / 2).alias("lon"))
    return (diagnosed.filter(F.col("anomalous") & F.col("state").isin("HEAVY", "CRITICAL")).join(middle, "segment_id")
            .select("segment_id", "ts", F.when(F.col("state") == "CRITICAL", "severe").otherwise("heavy").alias("severity"), "lat", "lon",
                    F.lower("confidence_label").alias("confidence")))


def traffic_zones(snaps: DataFrame) -> DataFrame:
    """Segments that are neither free nor without data."""
    return (snaps.withColumn("traffic_level", lookup("state", conf.LEVEL_OF_STATE))
            .filter(F.col("traffic_level").isin("moderate", "heavy", "severe"))
            .select("segment_id", "ts", "traffic_level", half_even("speed_kmh", 1).alias("speed_kmh"), half_even("congestion_index", 3).alias("congestion")))


def zone_counts(snaps: DataFrame) -> DataFrame:
    level = lookup("state", conf.LEVEL_OF_STATE)
    return snaps.groupBy("ts").agg(*[F.count_if(level == n).alias(n) for n in conf.LEVEL_OF_STATE.values()])


def find_segments(points: DataFrame, lines: DataFrame, ratios: DataFrame, radius_m: float = conf.MATCH_RADIUS_M,
                  fallback_m: float = conf.FALLBACK_M) -> DataFrame:
    """For each point (point_id, lat, lon) and slot: the most congested segment within the radius, else the nearest congested one."""
    spots = points.select("point_id", geo.project_x("lon").alias("x"), geo.project_y("lat").alias("y"))
    pairs = near_pairs(spots, lines.select("segment_id", "ax", "ay", "bx", "by"), fallback_m)
    slow = ratios.filter(F.col("speed_ratio") < conf.STATES[0][1]).select("segment_id", "ts", "speed_ratio")
    far = F.col("dist_m") > radius_m
    # Near ones by ratio, far ones by distance; near before far.
    order = F.struct(far.alias("far"), F.round(F.when(far, F.col("dist_m")).otherwise(F.col("speed_ratio")), 9).alias("by"), F.col("segment_id").alias("id"))
    return (pairs.select("point_id", "segment_id", "dist_m").join(slow, "segment_id").groupBy("point_id", "ts")
            .agg(F.min(order).alias("best")).select("point_id", "ts", F.col("best.id").alias("segment_id"), (~F.col("best.far")).alias("near")))


def nearest_places(points: DataFrame, places: DataFrame, radius_m: float, keep: int = conf.NEAREST_PER_CATEGORY) -> DataFrame:
    """The ``keep`` nearest places of each category around each point, within the search radius."""
    cell = radius_m * 1.02  # the planar cells must not miss what the sphere still counts as inside
    spots = geo.point_cell(points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), geo.project_x("lon").alias("px"),
                                         geo.project_y("lat").alias("py")), "px", "py", cell)
    side = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spots = (spots.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
             .withColumns({"cell_x": F.col("cell_x") + F.col("dx"), "cell_y": F.col("cell_y") + F.col("dy")}))
    there = geo.point_cell(places.withColumns({"qx": geo.project_x("lon"), "qy": geo.project_y("lat")}), "qx", "qy", cell)
    order = Window.partitionBy("point_id", "category").orderBy(F.round("distance_m", 6), "poi_id")
    return (spots.join(there, ["cell_x", "cell_y"]).withColumn("distance_m", geo.haversine("p_lat", "p_lon", "lat", "lon"))
            .filter(F.col("distance_m") <= radius_m).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
            .select("point_id", "category", "poi_id", "name", "distance_m", "place"))


NEIGHBOR_SLOWING = 0.05


def explanations(diagnosed: DataFrame, types: DataFrame, items: DataFrame, outlook: DataFrame) -> DataFrame:
    """Plain explanation of every cell: status, cause label, how certain, which evidence counts, and what the forecast says.

    ``types``: (segment_id, ts, likely_type, type_confidence) of flagged runs; ``items``: the evidence table; ``outlook``: one row per horizon.
    """
    trends = outlook.groupBy("segment_id", "ts").agg(F.max("trend").alias("trend"))
    slowing = F.coalesce(F.col("neighbor_max_drop") >= NEIGHBOR_SLOWING, F.lit(False))
    figure = lambda name, column: F.max(F.when(F.col("metric") == name, F.col(column)))
    facts = items.groupBy("segment_id", "ts").agg(
        figure("speed", "diff_pct").alias("speed_diff"), figure("queue_change_15min", "value").alias("queue_change"),
        (figure("congestion_index", "value") - figure("congestion_index", "baseline")).alias("congestion_rise"))
    level = lookup("state", conf.LEVEL_OF_STATE)
    normal, cause, rain = F.col("traffic_level").isin("free_flow", "no_data"), F.col("cause"), F.col("rain_intensity") >= conf.RAIN_EFFECT
    typed = (F.col("type_confidence") == "MEDIUM") & (F.col("likely_type") != "UNKNOWN")
    weather = F.when(rain | F.col("event_present"), "Weather or event slowdown").otherwise("City-wide slowdown")
    signals = {"speed_drop": F.col("speed_diff") <= -10, "sudden_onset": F.col("onset_step") >= 0.1, "queue_growth": F.col("queue_change") >= 5,
               "congestion_change": F.col("congestion_rise") >= 0.15, "roadwork": F.lit(True), "weather": rain,
               "recurring": cause == "RECURRING_BOTTLENECK"}
    note = (F.when(normal | F.col("trend").isNull(), None).when((F.col("trend") == "worsening") & slowing, "building, nearby roads slow too")
            .when(F.col("trend") == "worsening", "building").when(F.col("trend") == "easing", "easing").otherwise("about the same"))
    diagnosed = diagnosed.join(trends, ["segment_id", "ts"], "left")
    return (diagnosed.join(facts, ["segment_id", "ts"], "left").join(types, ["segment_id", "ts"], "left").withColumn("traffic_level", level)
            .withColumns({
                "status": F.when(normal, "normal").when(cause == "TRANSIENT_INCIDENT", "disruption_detected").otherwise("congestion"),
                "cause_label": F.when(normal, None).when(cause == "ROADWORK_EFFECT", "Roadwork").when(cause == "TRANSIENT_INCIDENT", "Traffic disruption")
                .when(cause == "PROPAGATED_CONGESTION", "Congestion spreading from nearby roads").when(cause == "RECURRING_BOTTLENECK", "Recurring congestion")
                .when(cause == "WEATHER_EVENT_EFFECT", weather).otherwise("Cause unclear"),
                "certainty": F.when(normal, None).when(cause == "ROADWORK_EFFECT", "reported")
                .when(cause == "TRANSIENT_INCIDENT", F.when(F.col("confidence_label") == "HIGH", "likely").otherwise("possible"))
                .when(cause.isin("PROPAGATED_CONGESTION", "RECURRING_BOTTLENECK"), "likely").when(cause == "WEATHER_EVENT_EFFECT", "possible")
                .otherwise("unknown"),
                "type": F.when(~normal & (cause == "TRANSIENT_INCIDENT"), F.when(typed, F.col("likely_type")).otherwise("undetermined")),
                "signals": F.when(normal, "").otherwise(F.concat_ws(",", *[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in signals.items()])),
                "forecast_note": note, "may_spread": ~normal & slowing & F.coalesce(F.col("trend") != "easing", F.lit(False))})
            .select("segment_id", "ts", "traffic_level", "status", "cause_label", "certainty", "type", "signals", "trend", "forecast_note", "may_spread"))
