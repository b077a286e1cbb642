"""Road tables derived from the driver's star-schema tables (see FIXTURES.md).

The city grows with the data: every hundred suppliers make one district, a copy of the 5 x 5 node lattice spanned by the nation
table, so the number of segments, and with it the panel, grows in step with the events. With up to a hundred suppliers there is
one district of 80 segments.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import conf
from ..functions import slots

SEGMENTS_PER_DISTRICT = 80
NODES_PER_DISTRICT = 25
SUPPLIERS_PER_DISTRICT = 100
DISTRICT_WIDTH_DEG = 0.126

# Names used by the derived tables.
INCIDENT_TYPES = ("accident_like", "demand_surge", "lane_blockage", "road_closure", "stalled_vehicle")
INTERVENTION_TYPES = ("capacity_upgrade", "connector", "lane_addition", "signal_retiming", "turn_lane")
RESTRICTIONS = ("no_turn", "no_left", "time_window")
BANDS = ("high", "medium", "low")
POI_CATEGORIES = ("hospital", "fuel", "food", "bus", "metro", "parking")


def pick(index, names):
    """The name at a zero-based index."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


class Analog:
    """The road tables over one driver directory, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: conf.Settings = conf.SIX_HOURLY):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- network
    @cached_property
    def districts(self) -> DataFrame:
        return self.raw("supplier").select(F.expr(f"s_suppkey div {SUPPLIERS_PER_DISTRICT}").alias("district")).distinct()

    @cached_property
    def n_districts(self) -> int:
        return self.districts.count()

    @property
    def n_segments(self) -> int:
        return SEGMENTS_PER_DISTRICT * self.n_districts

    @cached_property
    def lattice(self) -> DataFrame:
        k = F.col("k")
        return (self.raw("nation").select(F.col("n_nationkey").cast("long").alias("k"))
                .withColumn("district", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_districts - 1).cast("long"))))
                .select("district", "k", (k + NODES_PER_DISTRICT * F.col("district")).alias("node_id"),
                        (k % 5).alias("x"), F.expr("k div 5").alias("y")))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.lattice.select(
            "node_id", "x", "y", (F.lit(17.30) + F.col("y") * 0.018).alias("lat"),
            (F.lit(78.35) + F.col("x") * 0.018 + F.col("district") * DISTRICT_WIDTH_DEG).alias("lon"))

    @cached_property
    def segments(self) -> DataFrame:
        ends = self.lattice.select("district", F.col("k").alias("t"), F.col("node_id").alias("target_node"),
                                   F.col("x").alias("tx"), F.col("y").alias("ty"))
        steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"))
                          for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        pairs = (self.lattice.withColumn("step", F.explode(steps))
                 .select("district", F.col("k").alias("s"), F.col("node_id").alias("source_node"),
                         (F.col("x") + F.col("step.dx")).alias("tx"), (F.col("y") + F.col("step.dy")).alias("ty"))
                 .join(ends, ["district", "tx", "ty"]))
        rank = F.row_number().over(Window.partitionBy("district").orderBy("s", "t")) - 1
        s, t, local = F.col("s"), F.col("t"), F.col("local_idx")
        number = (F.col("idx") + 1).cast("string")
        return (pairs.withColumn("local_idx", rank.cast("long"))
                .withColumn("idx", local + SEGMENTS_PER_DISTRICT * F.col("district"))
                .withColumn("lanes", F.lit(2).cast("long") + (s + t) % 3)
                .select(F.concat(F.lit("R"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("segment_id"),
                        "idx", "source_node", "target_node",
                        F.when(F.col("lanes") >= 3, "arterial").otherwise("collector").alias("road_class"), "lanes",
                        (F.lit(40.0) + ((s * 3 + t) % 3) * 10).alias("free_flow_speed_kmh"),
                        (F.lit(900.0) * F.col("lanes")).alias("capacity_vph"),
                        (F.lit(0.8) + ((s + t * 2) % 7) * 0.1).alias("length_km"),
                        ((s + t) % 9 - 4).cast("double").alias("grade_pct"),
                        (F.lit(0.6) + ((s * 5 + t * 3) % 80) * 0.01).alias("importance"),
                        F.when(t % 4 != 0, F.concat(F.lit("S"), F.col("target_node").cast("string"))).alias("signal_id"),
                        (local % 27 == 5).cast("long").alias("structural_bottleneck"),
                        F.when(local % 27 == 5, F.lit(0.72)).otherwise(1.0).alias("peak_capacity_factor")))

    @cached_property
    def signals(self) -> DataFrame:
        k = F.col("k")
        return self.lattice.filter(k % 4 != 0).select(
            F.concat(F.lit("S"), F.col("node_id").cast("string")).alias("signal_id"), "node_id",
            (F.lit(60) + (k % 7) * 10).cast("long").alias("cycle_s"), (F.lit(0.35) + (k % 10) * 0.02).alias("green_ratio"))

    @cached_property
    def turn_restrictions(self) -> DataFrame:
        first = self.segments.select(F.col("segment_id").alias("from_segment"), F.col("idx").alias("a"),
                                     F.col("source_node").alias("a_source"), F.col("target_node").alias("node_id"))
        then = self.segments.select(F.col("segment_id").alias("to_segment"), F.col("idx").alias("b"),
                                    F.col("source_node").alias("node_id"), F.col("target_node").alias("b_target"))
        return (first.join(then, "node_id")
                .filter((F.col("a_source") != F.col("b_target")) & ((F.col("a") * 7 + F.col("b")) % 13 == 0))
                .select("node_id", "from_segment", "to_segment", pick((F.col("a") + F.col("b")) % 3, RESTRICTIONS).alias("restriction")))

    # ---- facts
    def _placed(self, events: DataFrame) -> DataFrame:
        """Events with the index of the segment they belong to."""
        return events.select(
            "event_id", F.col("ts").cast("timestamp").alias("event_ts"), "event_type", "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % self.n_segments).alias("idx"))

    @cached_property
    def _events(self) -> DataFrame:
        return self._placed(self.raw("events"))

    @cached_property
    def readings(self) -> DataFrame:
        return self._readings_of(self._events)

    def readings_stream(self) -> DataFrame:
        """The same readings as a stream over the event files."""
        files = self.spark.readStream.schema(self.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)
        return self._readings_of(self._placed(files))

    def _readings_of(self, placed: DataFrame) -> DataFrame:
        static = self.segments.select("idx", "segment_id", "free_flow_speed_kmh", "capacity_vph", "length_km")
        ff, cap, k, kind = F.col("free_flow_speed_kmh"), F.col("capacity_vph"), F.col("k"), F.col("event_type")
        share = F.lit(1.0) - F.least(F.col("value"), F.lit(400.0)) / 500.0
        flow = cap * (F.lit(0.2) + k * 0.006)
        return (placed.join(static, "idx")
                .select(slots.floor_slot("event_ts", self.cfg).alias("ts"), "segment_id", F.col("event_id").alias("ingest_seq"),
                        F.when((kind == "error") & (k % 3 == 0), -(ff * share)).otherwise(ff * share).alias("speed_kmh"),
                        F.when((kind == "signup") & (k == 99), flow * 10.0).otherwise(flow).alias("flow_vph"),
                        F.when((kind == "view") & (k == 98), F.lit(150.0)).otherwise(F.lit(7.0) + k * 0.9).alias("occupancy_pct"),
                        (F.lit(60.0) * F.col("length_km") / ff * (F.lit(1.0) / share - 1.0)).alias("delay_min"),
                        (F.col("value") / 10.0).alias("queue_length_veh"),
                        F.least(F.lit(1.0), F.col("value") / 500.0).alias("congestion_index"),
                        F.when(k == 50, F.lit(0.3)).otherwise(1.0).alias("sensor_quality")))

    @cached_property
    def slots(self) -> DataFrame:
        cfg = self.cfg
        return self.spark.range(1).select(F.explode(slots.slot_range(slots.at(cfg.start), slots.at(cfg.end), cfg)).alias("ts"))

    @cached_property
    def context(self) -> DataFrame:
        d = F.datediff("ts", slots.at(self.cfg.start))
        hour = F.hour("ts")
        return self.slots.select(
            "ts", (F.lit(20.0) + hour / 6.0 + (d % 10) * 0.5).alias("temperature_c"),
            F.when(d % 6 == 3, F.lit(0.4) + (d % 3) * 0.05).otherwise(0.0).alias("rain_intensity"),
            F.when((d % 10 == 7) & (hour == 18), 1).otherwise(0).cast("long").alias("event_level"),
            F.when(d.isin(0, 14, 25), 1).otherwise(0).cast("long").alias("holiday_flag"))

    def _labelled(self, kind: str, low: float, hours: int) -> DataFrame:
        return (self._events.filter((F.col("event_type") == kind) & (F.col("value") >= low))
                .join(self.segments.select("idx", "segment_id"), "idx")
                .withColumns({"start_time": F.col("event_ts"), "end_time": slots.shift("event_ts", 60 * hours)}))

    @cached_property
    def incidents(self) -> DataFrame:
        k = F.col("k")
        return self._labelled("click", 150.0, 13).select(
            F.concat(F.lit("I"), F.col("event_id").cast("string")).alias("incident_id"), "segment_id", "start_time", "end_time",
            pick(k % 5, INCIDENT_TYPES).alias("incident_type"), (k % 3 + 1).alias("severity"), (k % 2 + 1).alias("lanes_blocked"))

    @cached_property
    def roadworks(self) -> DataFrame:
        k = F.col("k")
        return self._labelled("signup", 200.0, 18).select(
            F.concat(F.lit("W"), F.col("event_id").cast("string")).alias("work_id"), "segment_id", "start_time", "end_time",
            (F.lit(0.2) + k * 0.005).alias("closure_fraction"), pick(k % 2, ("utility", "resurfacing")).alias("work_type"))

    def in_train(self, events: DataFrame) -> DataFrame:
        return events.filter(F.col("start_time") < slots.at(self.cfg.val_start))

    def in_validation(self, events: DataFrame) -> DataFrame:
        return events.filter(F.col("start_time") >= slots.at(self.cfg.val_start))

    # ---- planning, demand, routes, places
    @cached_property
    def candidates(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size").cast("long")
        return (self.raw("part").withColumn("idx", key % self.n_segments)
                .join(self.segments.select("idx", F.col("segment_id").alias("target_segment")), "idx")
                .select(F.concat(F.lit("PLAN"), F.lpad(key.cast("string"), 9, "0")).alias("candidate_id"), "target_segment",
                        pick(key % 5, INTERVENTION_TYPES).alias("intervention_type"),
                        ((size % 9 + 1) * 100).alias("capacity_delta_vph"), (size % 18 + 1).alias("cost_index"),
                        pick(size % 3, BANDS).alias("feasibility_band")))

    @cached_property
    def od_demand(self) -> DataFrame:
        # Quantities per (supplier, order) first, so that a supplier or customer with a large share of the lines cannot make the
        # dimension joins heavy.
        lines = self.raw("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
        origin = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("origin_node"))
        order = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
        customer = self.raw("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("destination_node"))
        return (lines.join(origin, "l_suppkey").join(order, "l_orderkey").join(customer, "c_custkey")
                .groupBy("origin_node", "destination_node").agg(F.sum("quantity").alias("base_demand_vph")))

    @cached_property
    def _route_nodes(self) -> DataFrame:
        spot = self.lattice.select("district", "x", "y", (F.lit(17.30) + F.col("y") * 0.018 + 0.001).alias("lat"),
                                   (F.lit(78.35) + F.col("x") * 0.018 + F.col("district") * DISTRICT_WIDTH_DEG + 0.001).alias("lon"))
        name = F.concat(F.lit("D"), F.col("district").cast("string"), F.lit("-"))
        across = spot.select(F.concat(name, F.lit("H"), F.col("y").cast("string")).alias("route_id"),
                             F.concat(name, F.lit("T"), F.col("y").cast("string")).alias("trip_id"), F.lit(True).alias("is_default"),
                             F.col("x").alias("seq"), "lat", "lon")
        down = spot.select(F.concat(name, F.lit("V"), F.col("x").cast("string")).alias("route_id"),
                           F.concat(name, F.lit("T"), F.col("x").cast("string")).alias("trip_id"), F.lit(False).alias("is_default"),
                           F.col("y").alias("seq"), "lat", "lon")
        return across.unionByName(down)

    @cached_property
    def route_vertices(self) -> DataFrame:
        return self._route_nodes.select("route_id", "seq", "lat", "lon")

    @cached_property
    def trips(self) -> DataFrame:
        return self._route_nodes.select("route_id", "trip_id", "is_default").distinct()

    @cached_property
    def pois(self) -> DataFrame:
        key = F.col("s_suppkey")
        district = F.expr(f"s_suppkey div {SUPPLIERS_PER_DISTRICT}")
        return self.raw("supplier").select(
            F.concat(F.lit("n"), key.cast("string")).alias("poi_id"), F.col("s_name").alias("name"),
            pick(F.col("s_nationkey") % 6, POI_CATEGORIES).alias("category"),
            (F.lit(17.30) + (key * 37 % 100) / 100.0 * 0.072).alias("lat"),
            (F.lit(78.35) + (key * 53 % 100) / 100.0 * 0.072 + district * DISTRICT_WIDTH_DEG).alias("lon"))
