"""The derived tables of one city, composed lazily; what many jobs share is written once and read back."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import slots
from ..operators import corridor, detect, diagnose, features, forecast, graph, panel, rider, routes, spread, whatif
from ..sources.analog import Analog
from ..sources.workspace import bucketed, clear, written


class City(Analog):
    # ---- base tables, written like the imported tables they stand for
    @cached_property
    def segments(self) -> DataFrame:
        return written(super().segments, "segments")

    @cached_property
    def nodes(self) -> DataFrame:
        return written(super().nodes, "nodes")

    @cached_property
    def signals(self) -> DataFrame:
        return written(super().signals, "signals")

    @cached_property
    def turn_restrictions(self) -> DataFrame:
        return written(super().turn_restrictions, "turn_restrictions")

    @cached_property
    def context(self) -> DataFrame:
        return written(super().context, "context")

    @cached_property
    def incidents(self) -> DataFrame:
        return written(super().incidents, "incidents")

    @cached_property
    def roadworks(self) -> DataFrame:
        return written(super().roadworks, "roadworks")

    @cached_property
    def route_vertices(self) -> DataFrame:
        return written(super().route_vertices, "route_vertices")

    # ---- grid
    @cached_property
    def n_cells(self) -> int:
        return self.n_segments * self.slots.count()

    @cached_property
    def raw_cells(self) -> DataFrame:
        return panel.cells(self.readings, self.segments, self.cfg)

    @cached_property
    def checked_cells(self) -> DataFrame:
        return panel.judged(self.raw_cells)

    def by_period(self, df: DataFrame, name: str, clustered: bool = False) -> DataFrame:
        """A table of cells: directories by period, in each of them the same buckets of segments."""
        dated = df.withColumn(slots.PERIOD, slots.period("ts", self.cfg))
        return bucketed(dated, name, ["segment_id"], ["segment_id", "ts"], self.n_cells, clustered, (slots.PERIOD,))

    @cached_property
    def dated_panel(self) -> DataFrame:
        return self.by_period(panel.sanitized(self.readings, self.segments, self.cfg), "panel", clustered=True)

    @property
    def panel(self) -> DataFrame:
        return self.dated_panel.drop(slots.PERIOD)

    # ---- network
    @cached_property
    def edges(self) -> DataFrame:
        """Neighbours, and the tile of the map that each pair belongs to."""
        return written(graph.tiled(graph.neighbors(self.segments), self.segments, self.nodes, self.n_segments), "edges")

    @cached_property
    def legal_turns(self) -> DataFrame:
        return graph.turns(self.segments, self.turn_restrictions, self.cfg)

    @cached_property
    def reach(self) -> DataFrame:
        return written(graph.hops(self.segments, edges=self.edges), "reach")

    @cached_property
    def detours(self) -> DataFrame:
        """The way around every segment, in each part of the day."""
        return written(graph.detours(self.segments, self.segments, self.legal_turns, self.nodes), "detours")

    # ---- detection
    @cached_property
    def ratios(self) -> DataFrame:
        return detect.with_daytype(features.with_ratios(self.panel, self.segments), self.context)

    def up_to(self, df: DataFrame, end: str) -> DataFrame:
        return slots.within(df, None, slots.at(end), self.cfg)

    @cached_property
    def incident_mask(self) -> DataFrame:
        return detect.label_mask(self.incidents, self.cfg)

    @cached_property
    def roadwork_mask(self) -> DataFrame:
        return detect.label_mask(self.roadworks, self.cfg)

    @cached_property
    def labelled(self) -> DataFrame:
        return self.incident_mask.unionByName(self.roadwork_mask).distinct()

    @cached_property
    def baseline(self) -> DataFrame:
        return written(detect.baseline(self.up_to(self.ratios, self.cfg.train_end), self.labelled), "baseline")

    @cached_property
    def dated_components(self) -> DataFrame:
        """Scored components of every cell."""
        return self.by_period(detect.scored(detect.components(self.ratios, self.baseline, self.edges), self.cfg), "components")

    @property
    def components(self) -> DataFrame:
        return self.dated_components.drop(slots.PERIOD)

    @cached_property
    def sweep(self) -> DataFrame:
        """Counts of every threshold tried; the calibration reads them too."""
        return written(detect.threshold_sweep(self.up_to(self.components, self.cfg.train_end), self.incident_mask, self.roadwork_mask), "sweep")

    @cached_property
    def bottlenecks(self) -> DataFrame:
        found = detect.bottlenecks(self.up_to(self.ratios, self.cfg.train_end), self.labelled, self.cfg)
        return written(found, "bottlenecks")

    @cached_property
    def roadworks_active(self) -> DataFrame:
        return detect.active_roadworks(self.roadworks, self.cfg)

    @cached_property
    def dated_diagnosed(self) -> DataFrame:
        full = diagnose.diagnoses(self.components, self.roadworks_active, self.bottlenecks, self.context, self.edges, self.cfg)
        return self.by_period(full, "diagnosed")

    @property
    def diagnosed(self) -> DataFrame:
        return self.dated_diagnosed.drop(slots.PERIOD)

    @cached_property
    def snapshots(self) -> DataFrame:
        return diagnose.snapshots(self.components, self.segments, self.bottlenecks, self.cfg)

    @cached_property
    def shapes(self) -> DataFrame:
        return written(diagnose.incident_shapes(self.in_train(self.incidents), self.components, self.cfg), "shapes")

    @cached_property
    def centroids(self) -> DataFrame:
        return diagnose.centroids(self.shapes)

    # ---- propagation
    @cached_property
    def calibration(self) -> DataFrame:
        samples = spread.calibration_samples(self.in_train(self.incidents), self.components, self.reach, self.cfg)
        return written(spread.calibrate(samples, self.cfg), "calibration")

    # ---- corridors
    @cached_property
    def segment_stats(self) -> DataFrame:
        return written(corridor.segment_stats(self.up_to(self.panel, self.cfg.train_end), self.segments, self.signals,
                                              self.in_train(self.incidents), self.bottlenecks, self.cfg), "segment_stats")

    @cached_property
    def norms(self) -> DataFrame:
        return written(corridor.norms(self.segment_stats), "norms")

    @cached_property
    def lines(self) -> DataFrame:
        return routes.segment_lines(self.segments, self.nodes)

    @cached_property
    def pieces(self) -> DataFrame:
        return written(routes.polyline(self.route_vertices), "pieces")

    @cached_property
    def route_facts(self) -> DataFrame:
        """Length and the provider's traffic-free duration (30 km/h) of every route."""
        return routes.lengths(self.pieces).select("route_id", (F.col("total_m") / 1000).alias("distance_km"),
                                                  (F.col("total_m") / 1000 / 30 * 60).alias("duration_min"))

    @cached_property
    def roads(self) -> DataFrame:
        """Named parts of the routes; every fourth piece has no name."""
        name = F.when(F.col("seq") == 2, F.concat(F.lit("Flyover "), "route_id")).otherwise(F.concat_ws("-", F.concat(F.lit("Road "), "route_id"), "seq"))
        return self.pieces.filter(F.col("seq") % 4 != 3).select("route_id", F.col("seq").alias("road_no"), name.alias("name"), "start_m", "end_m")

    @cached_property
    def junctions(self) -> DataFrame:
        return self.route_vertices.filter(F.col("seq").between(1, 3)).select("route_id", "lat", "lon")

    @cached_property
    def junction_sources(self) -> DataFrame:
        """Only the default routes come with junctions."""
        return self.trips.filter("is_default").select("route_id")

    @cached_property
    def stretches(self) -> DataFrame:
        return written(routes.stretches(self.route_vertices), "stretches")

    @cached_property
    def stretch_records(self) -> DataFrame:
        cut = written(routes.match(self.stretches, self.lines), "matched")
        cut = routes.junction_counts(routes.road_names(cut, self.roads), self.route_vertices, self.junctions, self.junction_sources)
        now = slots.within(self.dated_components, slots.at(self.AS_OF), slots.at(self.AS_OF), self.cfg).select("segment_id", "speed_ratio", "state")
        return written(corridor.stretch_records(cut, self.segment_stats, self.norms, now), "stretch_records")

    AS_OF = "2024-01-26 12:00:00"

    @cached_property
    def zones(self) -> DataFrame:
        return corridor.zones(self.stretch_records)

    @cached_property
    def extents(self) -> DataFrame:
        return written(corridor.extents(self.stretch_records, self.zones), "extents")

    @cached_property
    def inside(self) -> DataFrame:
        return corridor.covered(self.extents, self.stretch_records)

    # ---- riders
    @cached_property
    def sample_points(self) -> DataFrame:
        return routes.samples(self.route_vertices)

    @cached_property
    def sample_segments(self) -> DataFrame:
        return rider.sample_segments(self.sample_points, self.lines)

    @cached_property
    def rider_ratios(self) -> DataFrame:
        """Speed ratio now and as forecast for the next slot."""
        ahead = forecast.forecast_states(self.daily_forecast.filter(F.col("horizon_min") == self.cfg.step_minutes), self.segments)
        return self.components.select("segment_id", "ts", F.col("speed_ratio").alias("ratio_now")).join(
            ahead.select("segment_id", "ts", F.col("ratio").alias("ratio_later")), ["segment_id", "ts"], "left")

    @cached_property
    def sample_states(self) -> DataFrame:
        at_samples = rider.sample_ratios(self.sample_segments, self.rider_ratios, ["ratio_now", "ratio_later"])
        return written(rider.sample_states(self.sample_points, self.sample_segments, at_samples, self.slots), "sample_states")

    @cached_property
    def assessed(self) -> DataFrame:
        return written(rider.assess(self.sample_states, self.route_facts, self.nodes), "assessed")

    @cached_property
    def route_options(self) -> DataFrame:
        return rider.options(self.assessed, self.route_facts, self.trips)

    # ---- forecasts
    @cached_property
    def recorded(self) -> DataFrame:
        return written(forecast.recorded(self.panel, self.cfg), "recorded")

    @cached_property
    def bands(self) -> DataFrame:
        """Bands of the persistence forecast."""
        return written(forecast.residual_bands(forecast.persistence(self.panel, self.cfg), self.recorded, self.ratios, self.cfg), "bands")

    @cached_property
    def persistence(self) -> DataFrame:
        return forecast.with_bands(forecast.persistence(self.panel, self.cfg), self.bands, self.ratios, self.segments)

    def persistence_at(self, t: str) -> DataFrame:
        """The persistence forecast of one slot, from that slot's part of the panel."""
        now = slots.within(self.dated_panel, slots.at(t), slots.at(t), self.cfg)
        ratios = detect.with_daytype(features.with_ratios(now, self.segments), self.context)
        return forecast.with_bands(forecast.persistence(now, self.cfg), self.bands, ratios, self.segments)

    @cached_property
    def dated_forecast(self) -> DataFrame:
        """The forecast table that map, outlook, trend and riders read: known from past data alone, and sayable in SQL."""
        rows = forecast.with_bands(forecast.daily_change(self.panel, self.cfg), self.bands, self.ratios, self.segments)
        return written(rows.withColumn(slots.PERIOD, slots.period("ts", self.cfg)), "daily_forecast", (slots.PERIOD,))

    @property
    def daily_forecast(self) -> DataFrame:
        return self.dated_forecast.drop(slots.PERIOD)

    @cached_property
    def outlook_forecast(self) -> DataFrame:
        """The daily forecast of the speed, with bands from every slot of the calibration days."""
        speed = lambda df: df.filter("metric = 'speed'")
        bands = forecast.residual_bands(speed(forecast.persistence(self.panel, self.cfg)), speed(self.recorded), self.ratios, self.cfg, sampled=False)
        return written(forecast.with_bands(speed(forecast.daily_change(self.panel, self.cfg)), written(bands, "whole_bands"), self.ratios, self.segments), "outlook_forecast")

    # ---- planning
    @cached_property
    def links(self) -> DataFrame:
        return whatif.link_states(self.panel, self.segments, self.signals, self.cfg)

    @cached_property
    def cases(self) -> DataFrame:
        """Cells that call for a recommendation."""
        return self.diagnosed.filter(F.col("anomalous") | (F.col("state") != "NORMAL")).select(
            "segment_id", "ts", "state", "anomalous", "cause", "score", "speed_ratio", "confidence_label")

    @cached_property
    def shortlist(self) -> DataFrame:
        return whatif.shortlist(self.reach, self.segments, self.candidates)

    @cached_property
    def evaluated(self) -> DataFrame:
        return written(whatif.evaluate_candidates(self.cases, self.links, self.edges, self.shortlist, self.candidates, self.n_segments), "evaluated")

    @cached_property
    def evaluated_all(self) -> DataFrame:
        """The score of every feasible candidate within reach of a case. Not written: it has one reader, and hundreds of rows for a case."""
        tried = written(whatif.within_reach(self.reach, self.segments, self.candidates), "within_reach")
        return whatif.evaluate_candidates(self.cases, self.links, self.edges, tried, self.candidates, self.n_segments)

    @cached_property
    def advice(self) -> DataFrame:
        """What to do about every cell, with forecast and spill-over among the reasons."""
        ahead = forecast.rising(self.daily_forecast, list(self.cfg.horizons)[1])
        sources = self.components.filter("anomalous").select("segment_id", "ts", F.col("local_drop").alias("source_drop"))
        risks = spread.high_risks(spread.propagate(sources, self.components, self.reach, self.calibration))
        return written(whatif.advice(self.diagnosed, self.evaluated, ahead, risks, self.cfg.threshold), "advice")

    @cached_property
    def touched(self) -> DataFrame:
        return written(whatif.touched_links(self.cases, self.links, self.shortlist), "touched")


_cities: dict = {}


def release(spark: SparkSession) -> None:
    """Forgets the cities of this application and removes what they have written, for instance when the input has changed."""
    for key in [k for k in _cities if k[0] == spark.sparkContext.applicationId]:
        del _cities[key]
    clear(spark)


def city(spark: SparkSession, sf_dir: str) -> City:
    """The city of a driver directory; kept for the life of the Spark application."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(*graph.JOIN_IN_TILES)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cities:
        _cities[key] = City(spark, sf_dir)
    return _cities[key]
