"""The road network as edge tables: twins, neighbours, legal turns, reach, detours and connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import MAX_HOPS, Settings
from ..sources.workspace import checkpointed

NEIGHBOR_STATS = ("up_congestion", "down_congestion", "up_sr", "down_sr", "up_flow")


def twins(segments: DataFrame) -> DataFrame:
    """Each segment with the segment that runs the other way, if there is one."""
    back = segments.select(F.col("segment_id").alias("twin_id"), F.col("target_node").alias("source_node"),
                           F.col("source_node").alias("target_node"))
    return segments.select("segment_id", "source_node", "target_node").join(back, ["source_node", "target_node"], "left")


def neighbors(segments: DataFrame) -> DataFrame:
    """(segment_id, neighbor_id, direction): segments that end where this one starts, or start where it ends; never its twin."""
    own = twins(segments)
    other = segments.select(F.col("segment_id").alias("neighbor_id"), F.col("source_node").alias("n_source"),
                            F.col("target_node").alias("n_target"))
    not_twin = F.col("twin_id").isNull() | (F.col("neighbor_id") != F.col("twin_id"))
    up = own.join(other, F.col("source_node") == F.col("n_target")).filter(not_twin).withColumn("direction", F.lit("upstream"))
    down = own.join(other, F.col("target_node") == F.col("n_source")).filter(not_twin).withColumn("direction", F.lit("downstream"))
    return up.unionByName(down).select("segment_id", "neighbor_id", "direction")


def blocked_turns(restrictions: DataFrame, hour: Column, cfg: Settings) -> DataFrame:
    """Restrictions in force at an hour; an unknown (NULL) hour enforces everything."""
    always = F.col("restriction").isin("no_turn", "no_left")
    timed = (F.col("restriction") == "time_window") & (hour.isNull() | hour.isin(*cfg.peak_hours))
    return restrictions.filter(always | timed)


def turns(segments: DataFrame, restrictions: DataFrame, cfg: Settings) -> DataFrame:
    """Legal (bucket, from_segment, to_segment). U-turns count as turns."""
    first = segments.select(F.col("segment_id").alias("from_segment"), F.col("target_node").alias("node"))
    then = segments.select(F.col("segment_id").alias("to_segment"), F.col("source_node").alias("node"))
    pairs = first.join(then, "node").drop("node")
    in_peak = restrictions.filter(F.col("restriction").isin("no_turn", "no_left", "time_window"))
    off_peak = restrictions.filter(F.col("restriction").isin("no_turn", "no_left"))
    keys = ["from_segment", "to_segment"]
    return (pairs.join(in_peak.select(*keys), keys, "left_anti").withColumn("bucket", F.lit("peak"))
            .unionByName(pairs.join(off_peak.select(*keys), keys, "left_anti").withColumn("bucket", F.lit("offpeak"))))


def hops(segments: DataFrame, max_hops: int = MAX_HOPS, edges: DataFrame | None = None) -> DataFrame:
    """(segment_id, reached_id, hop, direction) for every segment at once.

    The direction is fixed by the first step, the first visit wins, and at equal distance upstream wins.
    """
    edges = neighbors(segments) if edges is None else edges
    step = edges.select(F.col("segment_id").alias("at"), F.col("neighbor_id").alias("next"), F.col("direction").alias("way"))

    def first_visits(found: DataFrame) -> DataFrame:
        # At one distance "upstream" sorts after "downstream", so max() prefers it.
        return found.groupBy("segment_id", "reached_id", "hop").agg(F.max("direction").alias("direction"))

    seen = first_visits(edges.select("segment_id", F.col("neighbor_id").alias("reached_id"), F.lit(1).cast("long").alias("hop"), "direction")
                        .filter(F.col("segment_id") != F.col("reached_id")))
    frontier = seen
    for hop in range(2, max_hops + 1):
        reached = (frontier.join(step, (F.col("reached_id") == F.col("at")) & (F.col("direction") == F.col("way")))
                   .filter(F.col("next") != F.col("segment_id"))
                   .select("segment_id", F.col("next").alias("reached_id"), F.lit(hop).cast("long").alias("hop"), "direction"))
        frontier = first_visits(reached).join(seen.select("segment_id", "reached_id"), ["segment_id", "reached_id"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen


TILE_SEGMENTS = 512
# rows that lie together by tile are joined by (tile, segment) where they are
JOIN_IN_TILES = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


def tiled(edges: DataFrame, segments: DataFrame, nodes: DataFrame, n_segments: int, per_tile: int = TILE_SEGMENTS) -> DataFrame:
    """``edges`` with the ``tile`` of segment_id: a square of the map, of such a size that it holds about ``per_tile`` segments on average."""
    tiles = max(1, n_segments // per_tile)
    spread = lambda c: F.max(c) - F.min(c)
    box = nodes.agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"), spread("lat").alias("high"), spread("lon").alias("wide"))
    lat0, lon0, high, wide = (box.select(c).scalar() for c in box.columns)
    side = F.greatest(F.sqrt(high * wide / tiles), F.greatest(high, wide) / tiles, F.lit(1e-9))
    at = nodes.select(F.col("node_id").alias("source_node"), F.struct(F.floor((F.col("lat") - lat0) / side).alias("y"), F.floor((F.col("lon") - lon0) / side).alias("x")).alias("tile"))
    own = segments.select("segment_id", "source_node").join(at, "source_node", "left").drop("source_node")
    nowhere = F.struct(F.lit(-1).cast("long").alias("y"), F.lit(-1).cast("long").alias("x"))
    return edges.join(own.withColumn("tile", F.coalesce("tile", nowhere)), "segment_id")


def neighbor_stat(values: DataFrame, edges: DataFrame, aggregates: list) -> DataFrame:
    """Aggregate the neighbours' rows of the same slot: ``values`` has (segment_id, ts, ...), ``edges`` their tiles.

    A row is sent once to its own tile and once to each tile in which a neighbour of its segment lies (at the border). There it meets the edges
    and is aggregated without moving again: what is shuffled follows the cells, not the edges.
    """
    beside = values.withColumnRenamed("segment_id", "neighbor_id")
    sent = beside.join(edges.select("neighbor_id", "tile").distinct(), "neighbor_id").repartition("tile")
    return sent.join(edges.repartition("tile"), ["tile", "neighbor_id"]).groupBy("tile", "segment_id", "ts").agg(*aggregates).drop("tile")


def neighbor_means(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean congestion, speed ratio and flow up- and downstream: a neighbour without data counts as free, no neighbour as zero."""
    def mean(direction, column, fill):
        return F.coalesce(F.avg(F.when(F.col("direction") == direction, F.coalesce(F.col(column), F.lit(fill)))), F.lit(0.0))

    picked = values.select("segment_id", "ts", "congestion_index", "speed_ratio", "flow_vph")
    stats = neighbor_stat(picked, edges, [
        mean("upstream", "congestion_index", 0.0).alias("up_congestion"),
        mean("downstream", "congestion_index", 0.0).alias("down_congestion"),
        mean("upstream", "speed_ratio", 1.0).alias("up_sr"),
        mean("downstream", "speed_ratio", 1.0).alias("down_sr"),
        mean("upstream", "flow_vph", 0.0).alias("up_flow")])
    names = NEIGHBOR_STATS
    return (values.join(stats, ["segment_id", "ts"], "left")
            .withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names}))


def path_legality(paths: DataFrame, segments: DataFrame, legal: DataFrame) -> DataFrame:
    """(path_id, legal) for paths given as (path_id, path array): consecutive segments meet and the turn is allowed. With a bucket in ``legal``
    every path is judged in each of its buckets."""
    buckets = ["bucket"] if "bucket" in legal.columns else []
    order = Window.partitionBy("path_id").orderBy("pos")
    steps = (paths.select("path_id", F.posexplode("path").alias("pos", "from_segment"))
             .withColumn("to_segment", F.lead("from_segment").over(order)))
    if buckets:
        known = [r.bucket for r in legal.select("bucket").distinct().collect()]  # peak and offpeak
        steps = steps.withColumn("bucket", F.explode(F.array(*[F.lit(k) for k in known])))
    allowed = legal.select(*buckets, "from_segment", "to_segment", F.lit(True).alias("allowed")).distinct()
    return (steps.join(allowed, [*buckets, "from_segment", "to_segment"], "left")
            .groupBy(*buckets, "path_id")
            .agg(F.bool_and(F.col("to_segment").isNull() | F.coalesce("allowed", F.lit(False))).alias("legal")))


def way_bounds(goals: DataFrame, ends: DataFrame, legal: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bound) of those goals that can be reached at all: what some legal way costs.

    Both ends search at once, one turn a round, until they meet. Where there is no way, the search is over as soon as one of its sides
    has nowhere left to go: a dead end is found out from inside, without labelling the network around it.
    """
    cost = ends.select("segment_id", "cost")
    onward = legal.select(*[k for k in keys if k != "blocked_id"], "from_segment", "to_segment")
    extra = [k for k in keys if k != "blocked_id"]

    def grown(frontier: DataFrame, seen: DataFrame, at: str, to: str, paid: str) -> DataFrame:
        step = onward.join(cost.select(F.col("segment_id").alias(paid), F.col("cost").alias("step_cost")), paid)
        far = (frontier.join(step.withColumn("segment_id", F.col(at)), [*extra, "segment_id"])
               .filter(F.col(to) != F.col("blocked_id")).groupBy(*keys, F.col(to).alias("next")).agg(F.min(F.col("cost") + F.col("step_cost")).alias("cost")))
        return far.withColumnRenamed("next", "segment_id").join(seen.select(*keys, "segment_id"), [*keys, "segment_id"], "left_anti")

    first = goals.join(ends, F.col("from_node") == F.col("source_node")).filter(F.col("segment_id") != F.col("blocked_id")).select(*keys, "segment_id", "cost")
    last = goals.join(ends, F.col("to_node") == F.col("target_node")).filter(F.col("segment_id") != F.col("blocked_id")).select(*keys, "segment_id", F.lit(0.0).alias("cost"))
    near = near_seen = checkpointed(first)
    far = far_seen = checkpointed(last)
    found = None
    while True:
        met = near_seen.join(far_seen.withColumnRenamed("cost", "rest"), [*keys, "segment_id"]).groupBy(*keys).agg(F.min(F.col("cost") + F.col("rest")).alias("bound"))
        found = checkpointed(met if found is None else found.unionByName(met))
        undecided = near.select(*keys).distinct().join(far.select(*keys).distinct(), keys).join(found, keys, "left_anti")
        undecided = checkpointed(undecided)
        if undecided.isEmpty():
            return found
        of = lambda df: df.join(undecided, keys, "left_semi")
        near_seen, far_seen = of(near_seen), of(far_seen)
        near = checkpointed(grown(of(near), near_seen, "from_segment", "to_segment", "to_segment"))
        # backwards a step costs the segment that is left behind
        far = checkpointed(grown(of(far), far_seen, "to_segment", "from_segment", "to_segment"))
        near_seen, far_seen = checkpointed(near_seen.unionByName(near)), checkpointed(far_seen.unionByName(far))


def detours(blocked: DataFrame, segments: DataFrame, legal: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Cheapest legal way around every blocked segment: (blocked_id, path, cost_hours), with a bucket in ``legal`` for each of its buckets.

    Label-correcting search run for all blocked segments together, only for those that have a way and from its cost as a first bound. Each round
    extends the labels that improved by one turn. A label goes no further when its cost and the least that is left to pay reach the bound: with ``nodes``
    that is the straight line to the goal at the cheapest cost per distance of the network, so the search stays between the two ends.
    """
    extra = [c for c in ("bucket",) if c in legal.columns]
    keys = [*extra, "blocked_id"]
    cost = F.col("length_km") / F.col("free_flow_speed_kmh")
    ends = segments.select("segment_id", "source_node", "target_node", cost.alias("cost"))
    goal = blocked.select(F.col("segment_id").alias("blocked_id")).distinct() \
        .join(ends.withColumnRenamed("segment_id", "blocked_id").drop("cost"), "blocked_id") \
        .withColumnsRenamed({"source_node": "from_node", "target_node": "to_node"})
    if extra:
        goal = goal.withColumn("bucket", F.explode(F.array(*[F.lit(r.bucket) for r in legal.select("bucket").distinct().collect()])))  # peak and offpeak
    goal = checkpointed(goal.join(way_bounds(goal, ends, legal, keys), keys))
    if nodes is None:
        place, slope = ends.select(F.col("target_node").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).distinct(), F.lit(0.0)
    else:
        place = nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
        at = lambda n: place.select(F.col("node_id").alias(f"{n}_node"), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
        span = F.hypot(F.col("source_x") - F.col("target_x"), F.col("source_y") - F.col("target_y"))
        slope = ends.join(at("source"), "source_node").join(at("target"), "target_node").filter(span > 0).agg(F.coalesce(F.min(F.col("cost") / span), F.lit(0.0))).scalar()
    # the least cost from a node to the goal: no way is cheaper per distance than the cheapest segment
    where = place.select(F.col("node_id").alias("target_node"), F.col("x").alias("at_x"), F.col("y").alias("at_y"))
    to = place.select(F.col("node_id").alias("to_node"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    goal = checkpointed(goal.join(to, "to_node"))
    left = F.hypot(F.col("at_x") - F.col("to_x"), F.col("at_y") - F.col("to_y")) * slope * (1 - 1e-9)
    step = checkpointed(legal.join(ends.join(where, "target_node").select(F.col("segment_id").alias("to_segment"), F.col("cost").alias("step_cost"),
                                                                          F.col("target_node").alias("step_target"), "at_x", "at_y"), "to_segment"))
    within = F.col("bound") * (1 + 1e-9)
    labels = (goal.join(ends, F.col("from_node") == F.col("source_node")).filter(F.col("segment_id") != F.col("blocked_id"))
              .select(*keys, "to_node", "to_x", "to_y", "bound", "segment_id", "target_node", "cost", F.array("segment_id").alias("path")))
    best = active = checkpointed(labels)
    while True:
        grown = (active.filter(F.col("target_node") != F.col("to_node"))
                 .join(step.withColumnRenamed("from_segment", "segment_id"), [*extra, "segment_id"])
                 .filter(F.col("to_segment") != F.col("blocked_id"))
                 .withColumn("new_cost", F.col("cost") + F.col("step_cost"))
                 .filter(F.col("new_cost") + left <= within)
                 .select(*keys, "to_node", "to_x", "to_y", "bound", F.col("to_segment").alias("segment_id"), F.col("step_target").alias("target_node"),
                         F.col("new_cost").alias("cost"), F.concat("path", F.array("to_segment")).alias("path"))
                 .groupBy(*keys, "to_node", "to_x", "to_y", "bound", "segment_id", "target_node")
                 .agg(F.min_by("path", F.struct("cost", F.concat_ws(",", "path"))).alias("path"), F.min("cost").alias("cost")))
        known = best.select(*keys, "segment_id", F.col("cost").alias("known_cost"))
        active = checkpointed(grown.join(known, [*keys, "segment_id"], "left")
                              .filter(F.col("known_cost").isNull() | (F.col("cost") < F.col("known_cost"))).drop("known_cost"))
        if active.isEmpty():
            break
        best = best.join(active.select(*keys, "segment_id"), [*keys, "segment_id"], "left_anti").unionByName(active.select(best.columns))
        # a complete way is a new bound for what is still looked for
        arrived = best.filter(F.col("target_node") == F.col("to_node")).groupBy(*keys).agg(F.min("cost").alias("paid"))
        best = checkpointed(best.join(arrived, keys, "left").withColumn("bound", F.least("bound", F.coalesce("paid", "bound"))).drop("paid"))
        active = active.drop("bound").join(best.groupBy(*keys).agg(F.min("bound").alias("bound")), keys)
    return (best.filter(F.col("target_node") == F.col("to_node"))
            .groupBy(*keys).agg(F.min_by("path", F.struct("cost", F.concat_ws(",", "path"))).alias("path"),
                                F.min("cost").alias("cost_hours")))


def out_degrees(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(out_degree, nodes): how many nodes have how many exits."""
    exits = segments.groupBy(F.col("source_node").alias("node_id")).agg(F.count("*").alias("out_degree"))
    return (nodes.select("node_id").join(exits, "node_id", "left")
            .groupBy(F.coalesce("out_degree", F.lit(0)).alias("out_degree")).agg(F.count("*").alias("nodes")))


def reach_count(segments: DataFrame, start: DataFrame, forward: bool) -> int:
    """Nodes reached from ``start`` (one node), by frontier joins until nothing new appears."""
    a, b = ("source_node", "target_node") if forward else ("target_node", "source_node")
    edges = segments.select(F.col(a).alias("node_id"), F.col(b).alias("next_id")).distinct()
    seen = frontier = checkpointed(start.select("node_id"))
    while True:
        fresh = (frontier.join(edges, "node_id").select(F.col("next_id").alias("node_id")).distinct()
                 .join(seen, "node_id", "left_anti"))
        frontier = checkpointed(fresh)
        if frontier.isEmpty():
            return seen.count()
        seen = checkpointed(seen.unionByName(frontier))


def strongly_connected(segments: DataFrame, nodes: DataFrame) -> bool:
    """Every node reaches every other: one node reaches all, forwards and backwards."""
    total = nodes.count()
    start = nodes.agg(F.min("node_id").alias("node_id"))
    return reach_count(segments, start, True) == total and reach_count(segments, start, False) == total


def summary(nodes: DataFrame, segments: DataFrame, restrictions: DataFrame, legal: DataFrame) -> DataFrame:
    """Long (metric, value) description of the network."""
    def metric(name, df, expr):
        return df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [metric("nodes", nodes, F.count("*")), metric("segments", segments, F.count("*")),
             metric("turn_restrictions", restrictions, F.count("*")),
             metric("legal_turns_peak", legal, F.count_if(F.col("bucket") == "peak")),
             metric("legal_turns_offpeak", legal, F.count_if(F.col("bucket") == "offpeak")),
             out_degrees(segments, nodes).select(F.concat(F.lit("out_degree_"), F.col("out_degree").cast("string")).alias("metric"),
                                                 F.col("nodes").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def geometry(segments: DataFrame, nodes: DataFrame, offset: float = 0.0012) -> DataFrame:
    """Segment end points, moved sideways so that the two directions of a road do not overlap."""
    a = nodes.select(F.col("node_id").alias("source_node"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = nodes.select(F.col("node_id").alias("target_node"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    dx, dy = F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat")
    length = F.hypot(dx, dy)
    length = F.when(length == 0, F.lit(1.0)).otherwise(length)
    ox, oy = -dy / length * offset, dx / length * offset
    return (segments.join(a, "source_node").join(b, "target_node")
            .select("segment_id", "source_node", "target_node", "road_class", "lanes", (F.col("a_lon") + ox).alias("lon1"),
                    (F.col("a_lat") + oy).alias("lat1"), (F.col("b_lon") + ox).alias("lon2"), (F.col("b_lat") + oy).alias("lat2")))


def geojson_features(shapes: DataFrame) -> DataFrame:
    """One GeoJSON feature per line, ready for ``write.text``."""
    line = F.struct(F.lit("LineString").alias("type"),
                    F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2")).alias("coordinates"))
    properties = F.struct("segment_id", "road_class", "lanes", "source_node", "target_node")
    return shapes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"),
                                            properties.alias("properties"))).alias("value"))
