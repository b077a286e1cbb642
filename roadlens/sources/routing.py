"""Provider responses as tables: routing JSON to routes, roads and junctions; place elements to normalised places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESPONSE = ("struct<code:string,routes:array<struct<distance:double,duration:double,geometry:struct<coordinates:array<array<double>>>,"
            "legs:array<struct<steps:array<struct<name:string,distance:double,"
            "intersections:array<struct<location:array<double>,bearings:array<int>>>>>>>>>>")
ELEMENT = "struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>"


def parsed(responses: DataFrame) -> DataFrame:
    """(request_id, route_no, route): the routes of every successful response (request_id, body)."""
    body = F.from_json("body", RESPONSE).alias("r")
    return (responses.select("request_id", body).filter(F.col("r.code") == "Ok")
            .select("request_id", F.posexplode("r.routes").alias("route_no", "route")))


def route_table(routes: DataFrame) -> DataFrame:
    return routes.select("request_id", "route_no", (F.col("route.distance") / 1000).alias("distance_km"), (F.col("route.duration") / 60).alias("duration_min"))


def vertex_table(routes: DataFrame) -> DataFrame:
    return (routes.select("request_id", "route_no", F.posexplode("route.geometry.coordinates").alias("seq", "c"))
            .select("request_id", "route_no", "seq", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon")))


def steps(routes: DataFrame) -> DataFrame:
    """Steps with the distance at which each begins and ends; unnamed steps count for the distance too."""
    flat = (routes.select("request_id", "route_no", F.posexplode("route.legs").alias("leg_no", "leg"))
            .select("request_id", "route_no", "leg_no", F.posexplode("leg.steps").alias("step_no", "step")))
    order = Window.partitionBy("request_id", "route_no").orderBy("leg_no", "step_no")
    metres = F.coalesce("step.distance", F.lit(0.0))
    return (flat.withColumn("end_m", F.sum(metres).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumns({"start_m": F.col("end_m") - metres, "road_no": F.row_number().over(order) - 1}))


def road_table(in_steps: DataFrame) -> DataFrame:
    named = F.coalesce(F.length("step.name") > 0, F.lit(False))
    return in_steps.filter(named).select("request_id", "route_no", "road_no", F.col("step.name").alias("name"), "start_m", "end_m")


def junction_table(in_steps: DataFrame) -> DataFrame:
    """Intersections with at least three approaches."""
    return (in_steps.select("request_id", "route_no", F.explode("step.intersections").alias("i"))
            .filter((F.size("i.bearings") >= 3) & F.col("i.location").isNotNull())
            .select("request_id", "route_no", F.bround(F.col("i.location")[1], 5).alias("lat"), F.bround(F.col("i.location")[0], 5).alias("lon")))


def category():
    """Place category from the tags."""
    t = F.col("tags")
    is_ = lambda key, value: F.coalesce(t[key] == value, F.lit(False))
    return (F.when(is_("amenity", "hospital"), "hospital").when(is_("amenity", "fuel"), "fuel")
            .when(is_("amenity", "restaurant") | is_("amenity", "fast_food"), "food").when(is_("highway", "bus_stop"), "bus")
            .when((is_("railway", "station") & is_("station", "subway")) | (is_("public_transport", "station") & is_("subway", "yes")), "metro")
            .when(is_("amenity", "parking"), "parking"))


def places(elements: DataFrame) -> DataFrame:
    """Normalised places from element JSON (column ``body``): category, position (or centre), address; one row per (type, id)."""
    e = elements.select(F.from_json("body", ELEMENT).alias("e")).select("e.*")
    t = F.col("tags")
    text = lambda *keys: F.coalesce(*[F.when(F.length(t[k]) > 0, t[k]) for k in keys])
    street = F.concat_ws(" ", text("addr:housenumber"), text("addr:street"))
    address = F.concat_ws(", ", F.when(F.length(street) > 0, street), text("addr:suburb"), text("addr:city"))
    out = e.select(
        F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("poi_id"), category().alias("category"),
        text("name").alias("name"), F.coalesce("lat", "center.lat").alias("lat"),
        F.when(F.col("lat").isNotNull(), F.col("lon")).otherwise(F.col("center.lon")).alias("lon"),
        F.when(F.length(address) > 0, address).alias("address"), text("opening_hours").alias("opening_hours"),
        text("phone", "contact:phone").alias("phone"), text("website").alias("website"))
    return out.filter(F.col("category").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).dropDuplicates(["poi_id"])
