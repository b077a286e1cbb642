"""Route geometry for whole tables of routes: lengths, positions along the line, resampling, cutting and segment matching.

``vertices`` always holds (route_id, seq, lat, lon).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import conf
from ..functions import geo
from ..functions.columns import half_even


def polyline(vertices: DataFrame) -> DataFrame:
    """The pieces of every route with the distance at which each starts and ends."""
    w = Window.partitionBy("route_id").orderBy("seq")
    spots = vertices.withColumns({"x": geo.project_x("lon"), "y": geo.project_y("lat")})
    pieces = spots.select("route_id", "seq", "lat", "lon", "x", "y", *[F.lead(c).over(w).alias(f"{c}2") for c in ("lat", "lon", "x", "y")]) \
        .filter(F.col("x2").isNotNull()).withColumn("piece_m", geo.distance("x", "y", "x2", "y2"))
    return (pieces.withColumn("end_m", F.sum("piece_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("start_m", F.col("end_m") - F.col("piece_m")))


def lengths(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("route_id").agg(F.max("end_m").alias("total_m"))


def locate(points: DataFrame, pieces: DataFrame, at: str, prefix: str = "") -> DataFrame:
    """Position (lat, lon, x, y) of each point ``at`` metres along its route.

    Points and pieces are merged in route order and each point takes the last piece that starts before it, so the work is linear
    in both instead of one pair per point and piece.
    """
    piece = F.struct("start_m", "end_m", "lat", "lon", "x", "y", "lat2", "lon2", "x2", "y2")
    columns = [c for c in points.columns if c != "route_id"]
    asked = points.select("route_id", F.col(at).alias("l_at"), F.lit(1).alias("l_kind"), F.struct(*columns).alias("l_point"),
                          F.lit(None).cast(pieces.select(piece.alias("p")).schema["p"].dataType).alias("l_piece"))
    given = pieces.select("route_id", F.col("start_m").alias("l_at"), F.lit(0).alias("l_kind"),
                          F.lit(None).cast(asked.schema["l_point"].dataType).alias("l_point"), piece.alias("l_piece"))
    w = Window.partitionBy("route_id").orderBy("l_at", "l_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = (given.unionByName(asked).withColumn("l_on", F.last("l_piece", ignorenulls=True).over(w)).filter("l_kind = 1"))
    on = F.col("l_on")
    span = on["end_m"] - on["start_m"]
    share = F.when(span > 0, F.least((F.col("l_at") - on["start_m"]) / span, F.lit(1.0))).otherwise(F.lit(0.0))
    return placed.select("route_id", "l_point.*", *[(on[c] + share * (on[f"{c}2"] - on[c])).alias(prefix + c)
                                                    for c in ("lat", "lon", "x", "y")])


def stretches(vertices: DataFrame, length_m: float = conf.STRETCH_M, most: int = conf.MAX_STRETCHES, shortest_m: float = 20.0) -> DataFrame:
    """Equal stretches of about ``length_m`` that cover each route exactly; routes shorter than ``shortest_m`` are left out."""
    pieces = polyline(vertices)
    n = F.least(F.greatest(half_even(F.col("total_m") / length_m), F.lit(1)), F.lit(most)).cast("int")
    cut = (lengths(pieces).filter(F.col("total_m") >= shortest_m).withColumn("n", n)
           .withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
           .select("route_id", "total_m", "n", F.col("idx").cast("long").alias("idx"), (F.col("total_m") / F.col("n") * F.col("idx")).alias("from_m"),
                   (F.col("total_m") / F.col("n") * (F.col("idx") + 1)).alias("to_m"))
           .withColumn("length_m", F.col("to_m") - F.col("from_m")))
    return locate(locate(cut, pieces, "from_m", "start_"), pieces, "to_m", "end_")


def stretch_shapes(cut: DataFrame, vertices: DataFrame) -> DataFrame:
    """The line of each stretch: its ends and the route's own vertices strictly between them, as one array."""
    pieces = polyline(vertices)
    inner = pieces.select("route_id", F.col("end_m").alias("at_m"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    sizes = cut.groupBy("route_id").agg(F.max("total_m").alias("total_m"), F.max("n").alias("n"))
    inner = inner.join(sizes, "route_id").withColumn("idx", F.least(F.floor(F.col("at_m") / (F.col("total_m") / F.col("n"))), F.col("n") - 1))
    held = (cut.select("route_id", "idx", "from_m", "to_m").join(inner, ["route_id", "idx"])
            .filter((F.col("at_m") > F.col("from_m")) & (F.col("at_m") < F.col("to_m")))
            .groupBy("route_id", "idx").agg(F.array_sort(F.collect_list(F.struct("at_m", "lat", "lon"))).alias("inner")))
    spot = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    between = F.transform(F.coalesce("inner", F.array().cast(held.schema["inner"].dataType)),
                          lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return (cut.join(held, ["route_id", "idx"], "left")
            .withColumn("coords", F.concat(F.array(spot("start_lat", "start_lon")), between, F.array(spot("end_lat", "end_lon"))))
            .drop("inner"))


def samples(vertices: DataFrame, step_m: float = conf.SAMPLE_M) -> DataFrame:
    """Points about every ``step_m`` metres with the length each represents (half-way to its neighbours)."""
    pieces = polyline(vertices)
    n = F.greatest(F.ceil(F.col("total_m") / step_m) + 1, F.lit(2)).cast("int")
    gap = F.col("total_m") / (F.col("n") - 1)
    edge = F.col("idx").isin(0) | (F.col("idx") == F.col("n") - 1)
    points = (lengths(pieces).withColumn("n", n).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .select("route_id", "total_m", F.col("idx").cast("long").alias("idx"), (gap * F.col("idx")).alias("at_m"),
                      F.when(edge, gap / 2).otherwise(gap).alias("ds_m")))
    return locate(points, pieces, "at_m")


def segment_lines(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments as straight lines in metres."""
    a = nodes.select(F.col("node_id").alias("source_node"), geo.project_x("lon").alias("ax"), geo.project_y("lat").alias("ay"),
                     F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = nodes.select(F.col("node_id").alias("target_node"), geo.project_x("lon").alias("bx"), geo.project_y("lat").alias("by"),
                     F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return segments.select("segment_id", "source_node", "target_node").join(a, "source_node").join(b, "target_node") \
        .drop("source_node", "target_node")


def near_pairs(points: DataFrame, lines: DataFrame, reach_m: float, x: str = "x", y: str = "y") -> DataFrame:
    """Every (point, segment) pair within ``reach_m``, with its distance.

    A line is listed under each cell its widened box touches and a point under its own cell only: an equi-join without duplicates.
    """
    cell = 2 * reach_m
    boxed = geo.covering_cells(lines, "ax", "ay", "bx", "by", reach_m, cell)
    return (geo.point_cell(points, x, y, cell).join(boxed, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
            .withColumn("dist_m", geo.distance_to_line(x, y, "ax", "ay", "bx", "by")).filter(F.col("dist_m") <= reach_m))


def match(cut: DataFrame, lines: DataFrame, radius_m: float = conf.MATCH_RADIUS_M, tolerance_m: float = conf.MATCH_TOLERANCE_M) -> DataFrame:
    """The segment each stretch runs on: nearest within the radius; among the about equally near, the one in travel direction."""
    spots = cut.select("route_id", "idx", ((F.col("start_x") + F.col("end_x")) / 2).alias("mx"),
                       ((F.col("start_y") + F.col("end_y")) / 2).alias("my"), (F.col("end_x") - F.col("start_x")).alias("tx"),
                       (F.col("end_y") - F.col("start_y")).alias("ty"))
    pairs = near_pairs(spots, lines, radius_m + tolerance_m, "mx", "my")
    sx, sy, tx, ty = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("tx"), F.col("ty")
    cos = (sx * tx + sy * ty) / (F.sqrt(sx * sx + sy * sy) * F.sqrt(tx * tx + ty * ty) + 1e-9)
    keys = ["route_id", "idx"]
    nearest = F.min("dist_m").over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.round("cos", 9).desc(), "segment_id")
    best = (pairs.withColumns({"cos": cos, "nearest_m": nearest})
            .filter((F.col("nearest_m") <= radius_m) & (F.col("dist_m") <= F.col("nearest_m") + tolerance_m))
            .withColumn("place", F.row_number().over(order)).filter("place = 1")
            .select(*keys, F.col("segment_id").alias("grid_segment_id"), F.col("dist_m").alias("match_distance_m")))
    return cut.join(best, keys, "left")


def road_names(cut: DataFrame, roads: DataFrame) -> DataFrame:
    """The road name that covers most of each stretch (the first on a tie). ``roads`` holds (route_id, road_no, name, start_m, end_m).

    Roads are listed under every stretch they touch, computed from the equal stretch length, and met by an equi-join.
    """
    sizes = cut.groupBy("route_id").agg((F.max("total_m") / F.max("n")).alias("size_m"), F.max("n").alias("n"))
    last = F.least(F.floor(F.col("r_end") / F.col("size_m")), F.col("n") - 1).cast("long")
    first = F.floor(F.col("r_start") / F.col("size_m")).cast("long")
    listed = (roads.select("route_id", "road_no", F.col("name").alias("road_name"), F.col("start_m").alias("r_start"), F.col("end_m").alias("r_end"))
              .join(sizes, "route_id").filter(first <= last).withColumn("idx", F.explode(F.sequence(first, last))).drop("size_m", "n"))
    overlap = F.least("to_m", "r_end") - F.greatest("from_m", "r_start")
    best = (cut.select("route_id", "idx", "from_m", "to_m").join(listed, ["route_id", "idx"]).withColumn("overlap_m", overlap)
            .filter(F.col("overlap_m") > 0).groupBy("route_id", "idx")
            .agg(F.max_by("road_name", F.struct("overlap_m", -F.col("road_no"))).alias("road_name")))
    return cut.join(best, ["route_id", "idx"], "left")


def junction_counts(cut: DataFrame, vertices: DataFrame, junctions: DataFrame, sources: DataFrame) -> DataFrame:
    """Junctions within half a stretch of its middle. NULL, not zero, for routes whose source reports none at all
    (``sources`` lists the routes that come with road names or junctions)."""
    middle = locate(cut.select("route_id", "idx", "length_m", ((F.col("from_m") + F.col("to_m")) / 2).alias("mid_m")),
                    polyline(vertices), "mid_m")
    spots = junctions.select("route_id", geo.project_x("lon").alias("jx"), geo.project_y("lat").alias("jy"))
    size = cut.groupBy("route_id").agg(F.max("length_m").alias("size_m"))
    # A junction within half a length of the middle lies in the 3 x 3 cells of one stretch length around it.
    side = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    from_cells = (middle.withColumns({"cell_x": F.floor(F.col("x") / F.col("length_m")), "cell_y": F.floor(F.col("y") / F.col("length_m"))})
                  .withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
                  .withColumns({"cell_x": F.col("cell_x") + F.col("dx"), "cell_y": F.col("cell_y") + F.col("dy")}))
    in_cells = spots.join(size, "route_id").withColumns({"cell_x": F.floor(F.col("jx") / F.col("size_m")),
                                                         "cell_y": F.floor(F.col("jy") / F.col("size_m"))})
    counted = (from_cells.join(in_cells, ["route_id", "cell_x", "cell_y"])
               .filter(geo.distance("x", "y", "jx", "jy") <= F.col("length_m") / 2)
               .groupBy("route_id", "idx").agg(F.count("*").alias("junctions_near")))
    known = sources.select("route_id", F.lit(True).alias("has_source")).distinct()
    return (cut.join(counted, ["route_id", "idx"], "left").join(known, "route_id", "left")
            .withColumn("junction_count", F.when(F.col("has_source"), F.coalesce("junctions_near", F.lit(0))))
            .drop("junctions_near", "has_source"))


def requests_in_area(requests: DataFrame, area: dict = conf.SERVICE_AREA, nearest_km: float = 0.1, farthest_km: float = 40.0) -> DataFrame:
    """Requests with both ends inside the service area and a sensible distance between them."""
    inside = F.lit(True)
    for end in ("origin", "destination"):
        inside = inside & F.col(f"{end}_lat").between(area["south"], area["north"]) & F.col(f"{end}_lon").between(area["west"], area["east"])
    km = F.hypot((F.col("origin_lat") - F.col("destination_lat")) * 110.5, (F.col("origin_lon") - F.col("destination_lon")) * 104.0)
    return requests.withColumn("apart_km", km).filter(inside & (F.col("apart_km") >= nearest_km) & (F.col("apart_km") <= farthest_km))
