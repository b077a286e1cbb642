"""Link travel times, before/after comparison and the ranking of planning candidates, on observed flows.

Flows are fixed, so a scenario changes only the segments whose capacity it touches: network figures are the network's own total
minus what those segments contributed plus what they contribute now. No scenario visits the whole network again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import conf
from ..conf import Settings
from ..functions.columns import col, decimals, lookup


def webster_seconds(x, cycle, green) -> Column:
    """Uniform signal delay in seconds per vehicle."""
    x, cycle, green = col(x), col(cycle), col(green)
    load = F.when(x.isNotNull(), F.least(x, F.lit(0.95)))
    return 0.5 * cycle * (1 - green) * (1 - green) / (1 - load * green)


def link_hours(flow, capacity, free_hours, cycle, green) -> Column:
    """Travel time of a link in hours: volume-delay curve plus signal delay where there is a signal."""
    x = F.greatest(col(flow), F.lit(0.0)) / col(capacity)
    signal = F.when(col(cycle) > 0, webster_seconds(x, cycle, green) / 3600).otherwise(F.lit(0.0))
    return col(free_hours) * (1 + conf.BPR_ALPHA * x * x * x * x) + signal


def adjusted_capacity(capacity, multiplier=None, delta=None) -> Column:
    """Capacity after a loss (never below a tenth) and a gain; NULL when nothing positive is left."""
    out = col(capacity)
    if multiplier is not None:
        out = out * F.greatest(col(multiplier), F.lit(conf.MIN_CAPACITY_SHARE))
    if delta is not None:
        out = out + col(delta)
    return F.when(out > 0, out)


def link_states(panel: DataFrame, segments: DataFrame, signals: DataFrame, cfg: Settings) -> DataFrame:
    """Observed state of every link at every slot: flow, capacity at that hour, time in hours, utilisation."""
    static = (segments.select("segment_id", "length_km", "free_flow_speed_kmh", "capacity_vph", "peak_capacity_factor", "signal_id")
              .join(signals.select("signal_id", F.col("cycle_s").alias("cycle"), F.col("green_ratio").alias("green")), "signal_id", "left")
              .select("segment_id", "length_km", (F.col("length_km") / F.col("free_flow_speed_kmh")).alias("free_h"), "capacity_vph",
                      "peak_capacity_factor", F.coalesce("cycle", F.lit(0)).alias("cycle"), F.coalesce("green", F.lit(1.0)).alias("green")))
    peak = F.hour("ts").isin(*cfg.peak_hours)
    return (panel.select("segment_id", "ts", F.coalesce("flow_vph", F.lit(0.0)).alias("flow")).join(static, "segment_id")
            .withColumn("cap", F.col("capacity_vph") * F.when(peak, F.col("peak_capacity_factor")).otherwise(1.0))
            .withColumn("time_h", link_hours("flow", "cap", "free_h", "cycle", "green"))
            .withColumn("vc", F.col("flow") / F.col("cap"))
            .select("segment_id", "ts", "length_km", "free_h", "cycle", "green", "flow", "cap", "time_h", "vc"))


def vc_level(vc) -> Column:
    vc = col(vc)
    return (F.when(vc.isNull(), "no_data").when(vc < 0.6, "low").when(vc < 0.85, "medium").when(vc < 1.0, "high").otherwise("over_capacity"))


KPIS = ("travel_time_veh_h", "delay_veh_h", "avg_speed_kmh", "avg_congestion", "over_capacity_links", "over_capacity_flow_vph")


def network_kpis(links: DataFrame, keys=("ts",)) -> DataFrame:
    """Network figures per scenario."""
    flow, t, over = F.col("flow"), F.col("time_h"), F.col("vc") > 1
    return links.groupBy(*keys).agg(
        F.sum(flow * t).alias("travel_time_veh_h"), F.sum(flow * (t - F.col("free_h"))).alias("delay_veh_h"),
        (F.sum(flow * F.col("length_km")) / F.greatest(F.sum(flow * t), F.lit(1e-9))).alias("avg_speed_kmh"),
        (F.sum(flow * (1 - F.col("free_h") / t)) / F.greatest(F.sum(flow), F.lit(1e-9))).alias("avg_congestion"),
        F.count_if(over).cast("double").alias("over_capacity_links"), F.sum(F.when(over, flow).otherwise(0.0)).alias("over_capacity_flow_vph"))


def kpi_changes(before: DataFrame, after: DataFrame, keys=("ts",)) -> DataFrame:
    """Long (scenario, kpi, before, after, change, pct_change)."""
    keys = list(keys)
    a = network_kpis(before, keys).unpivot(keys, list(KPIS), "kpi", "before")
    b = network_kpis(after, keys).unpivot(keys, list(KPIS), "kpi", "after")
    change = F.col("after") - F.col("before")
    return a.join(b, [*keys, "kpi"]).withColumns({"change": change, "pct_change": F.when(F.col("before") != 0, change / F.col("before") * 100)})


def link_changes(before: DataFrame, after: DataFrame, keys=("ts",)) -> DataFrame:
    """Per link and scenario: time before and after, relative change, whether it moved by more than one percent."""
    on = [*keys, "segment_id"]
    a = before.select(*on, F.col("time_h").alias("time_before"), F.col("flow").alias("flow_before"), F.col("vc").alias("vc_before"))
    b = after.select(*on, F.col("time_h").alias("time_after"), F.col("flow").alias("flow_after"), F.col("vc").alias("vc_after"))
    rel = (F.col("time_after") - F.col("time_before")) / F.col("time_before")
    return a.join(b, on).withColumns({"delta_min": (F.col("time_after") - F.col("time_before")) * 60, "relative": rel,
                                      "moved": F.when(rel < -0.01, "improved").when(rel > 0.01, "worsened").otherwise("same")})


def change_counts(changes: DataFrame, keys=("ts",)) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count_if(F.col("moved") == "improved").alias("improved"),
                                      F.count_if(F.col("moved") == "worsened").alias("worsened"), F.count("*").alias("links"))


def largest_changes(changes: DataFrame, keys=("ts",), top: int = 5) -> DataFrame:
    """The ``top`` links that got worst and the ``top`` that improved most, per scenario."""
    size = F.when(F.col("moved") == "worsened", -F.col("delta_min")).otherwise(F.col("delta_min"))
    order = Window.partitionBy(*keys, "moved").orderBy("size", "segment_id")
    return (changes.filter(F.col("moved") != "same").withColumn("size", F.round(size, 9)).withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= top).drop("size"))


# ---- scenarios: what a candidate changes, as a table of the links it touches
CASE = ("segment_id", "ts", "candidate_id")


def touched_links(cases: DataFrame, links: DataFrame, tried: DataFrame) -> DataFrame:
    """Per case and tried candidate the links that differ from what was observed: the case's own link, which loses capacity by its state,
    and the candidate's target, which gains some. Capacity and time as seen, before the candidate (after the loss) and after it."""
    keep = F.when(F.col("anomalous"), 1 - lookup("state", conf.STATE_CAPACITY_LOSS, 0.0)).otherwise(F.lit(1.0))
    tries = cases.select("segment_id", "ts", keep.alias("keep")).join(
        tried.select("segment_id", "candidate_id", "target_segment", "hop", F.col("capacity_delta_vph").alias("gain")), "segment_id")
    none = F.lit(0).cast("long")
    which = F.array(F.struct(F.col("target_segment").alias("link_id"), F.when(F.col("hop") == 0, F.col("keep")).otherwise(1.0).alias("share"), F.col("gain").cast("long").alias("gain")),
                    F.when(F.col("hop") > 0, F.struct(F.col("segment_id").alias("link_id"), F.col("keep").alias("share"), none.alias("gain"))))
    rows = tries.select(*CASE, F.inline(F.array_compact(which))).join(links.withColumnRenamed("segment_id", "link_id"), ["link_id", "ts"])
    hours = lambda cap: link_hours("flow", cap, "free_h", "cycle", "green")
    return (rows.withColumn("cap_before", adjusted_capacity("cap", "share")).withColumn("cap_after", adjusted_capacity("cap_before", None, "gain"))
            .withColumns({"time_before": hours("cap_before"), "time_after": hours("cap_after")})
            .select(*CASE, "link_id", "flow", "length_km", "free_h", F.col("cap").alias("cap_seen"), F.col("time_h").alias("time_seen"), "cap_before", "time_before", "cap_after", "time_after"))


def _sums(cap: str, time: str) -> dict:
    """The sums that all network figures are made of."""
    flow, t, over = F.col("flow"), F.col(time), F.col("flow") > F.col(cap)
    return {"time": flow * t, "delay": flow * (t - F.col("free_h")), "km": flow * F.col("length_km"), "lost": flow * (1 - F.col("free_h") / t), "flow": flow,
            "over": over.cast("double"), "over_flow": F.when(over, flow).otherwise(0.0)}


def _figures(s) -> dict:
    small = F.lit(1e-9)
    return {"travel_time_veh_h": s("time"), "delay_veh_h": s("delay"), "avg_speed_kmh": s("km") / F.greatest(s("time"), small), "avg_congestion": s("lost") / F.greatest(s("flow"), small),
            "over_capacity_links": s("over"), "over_capacity_flow_vph": s("over_flow")}


def scenario_kpis(touched: DataFrame, links: DataFrame) -> DataFrame:
    """Long (case, candidate, kpi, before, after, change, pct_change): the network's sums of the slot, corrected by the touched links alone."""
    totals = links.groupBy("ts").agg(*[F.sum(e).alias(f"all_{n}") for n, e in _sums("cap", "time_h").items()])
    seen = _sums("cap_seen", "time_seen")
    moved = touched.groupBy(*CASE).agg(*[F.sum(e - seen[n]).alias(f"{stage}_{n}") for stage in ("before", "after") for n, e in _sums(f"cap_{stage}", f"time_{stage}").items()])
    rows = moved.join(totals, "ts")
    at = lambda stage: _figures(lambda n: F.col(f"all_{n}") + F.col(f"{stage}_{n}"))
    before, after = at("before"), at("after")
    long = rows.select(*CASE, F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), before[k].alias("before"), after[k].alias("after")) for k in KPIS])))
    change = F.col("after") - F.col("before")
    return long.withColumns({"change": change, "pct_change": F.when(F.col("before") != 0, change / F.col("before") * 100)})


def scenario_links(touched: DataFrame) -> DataFrame:
    """Per touched link: time and utilisation before and after the candidate, and whether it moved by more than one percent."""
    rel = (F.col("time_after") - F.col("time_before")) / F.col("time_before")
    return touched.withColumns({"delta_min": (F.col("time_after") - F.col("time_before")) * 60, "relative": rel, "vc_before": F.col("flow") / F.col("cap_before"),
                                "vc_after": F.col("flow") / F.col("cap_after"), "moved": F.when(rel < -0.01, "improved").when(rel > 0.01, "worsened").otherwise("same")})


def scenario_counts(changes: DataFrame, n_segments: int) -> DataFrame:
    """Per case and candidate: links improved and worsened, of all; whatever is not touched stays the same."""
    return changes.groupBy(*CASE).agg(F.count_if(F.col("moved") == "improved").alias("improved"), F.count_if(F.col("moved") == "worsened").alias("worsened"),
                                      F.lit(n_segments).alias("links"))


# ---- candidates
def candidate_pool(reach: DataFrame, segments: DataFrame, candidates: DataFrame, max_hops: int = conf.CANDIDATE_HOPS) -> DataFrame:
    """Candidates on each segment and on segments within ``max_hops``, nearest and cheapest first."""
    own = segments.select("segment_id", F.col("segment_id").alias("target_segment"), F.lit(0).cast("long").alias("hop"), F.lit("direct").alias("relation"))
    near = reach.filter(F.col("hop") <= max_hops).select(
        "segment_id", F.col("reached_id").alias("target_segment"), "hop",
        F.format_string("%s neighbor (hop %d)", "direction", "hop").alias("relation"))
    return own.unionByName(near).join(candidates, "target_segment")


def feasibility(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds the checks of each candidate: target exists, a signal to retime, at least two exits for a turn lane."""
    exits = segments.groupBy("source_node").agg(F.count("*").alias("exits")).withColumnRenamed("source_node", "target_node")
    target = (segments.select(F.col("segment_id").alias("target_segment"), "target_node", "signal_id", F.lit(True).alias("found"))
              .join(exits, "target_node", "left").drop("target_node"))
    kind = F.col("intervention_type")
    return (candidates.join(target, "target_segment", "left")
            .withColumns({"target_exists": F.coalesce("found", F.lit(False)),
                          "signal_ok": (kind != "signal_retiming") | F.col("signal_id").isNotNull(),
                          "exits_ok": (kind != "turn_lane") | (F.coalesce("exits", F.lit(0)) >= 2),
                          "band_note": F.when(F.col("feasibility_band") != "high", "penalised in ranking")})
            .withColumn("feasible", F.col("target_exists") & F.col("signal_ok") & F.col("exits_ok"))
            .drop("found", "signal_id", "exits"))


def within_reach(reach: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """All feasible candidates on each segment and around it, as :func:`evaluate_candidates` tries them: as many as there are. Made once per segment."""
    return candidate_pool(reach, segments, feasibility(candidates, segments).filter("feasible").select(*candidates.columns))


def shortlist(reach: DataFrame, segments: DataFrame, candidates: DataFrame, keep: int = conf.CANDIDATES_TRIED) -> DataFrame:
    """The feasible candidates tried for each segment. It does not depend on time, so it is made once per segment.

    Within one target the order is by cost alone, so no more than ``keep`` of its candidates can be tried anywhere: a target with very
    many candidates is cut to those before it meets the segments around it.
    """
    cheapest = Window.partitionBy("target_segment").orderBy("cost_index", "candidate_id")
    checked = (feasibility(candidates, segments).filter("feasible").select(*candidates.columns, F.row_number().over(cheapest).alias("of_target"))
               .filter(F.col("of_target") <= keep).drop("of_target"))
    order = Window.partitionBy("segment_id").orderBy("hop", "cost_index", "candidate_id")
    return (candidate_pool(reach, segments, checked).withColumn("tried", F.row_number().over(order)).filter(F.col("tried") <= keep))


def evaluate_candidates(cases: DataFrame, links: DataFrame, edges: DataFrame, tried: DataFrame, candidates: DataFrame, n_segments: int) -> DataFrame:
    """Score of every candidate in ``tried`` (:func:`within_reach`, or the first of them by :func:`shortlist`) for every case (segment_id, ts, state, anomalous).

    A detected case first loses capacity by its state; a candidate then adds its capacity on its target.
    """
    links = links.withColumn("delay", F.col("flow") * (F.col("time_h") - F.col("free_h")))
    totals = links.groupBy("ts").agg(F.sum("delay").alias("net_delay"), F.sum(F.col("flow") * F.col("time_h")).alias("net_time"))
    keep = F.when(F.col("anomalous"), 1 - lookup("state", conf.STATE_CAPACITY_LOSS, 0.0)).otherwise(F.lit(1.0))
    own = links.withColumnsRenamed({c: f"o_{c}" for c in ("flow", "cap", "free_h", "cycle", "green", "delay", "time_h")})
    beside = (cases.select("segment_id", "ts").join(edges.select("segment_id", "neighbor_id").distinct(), "segment_id")
              .join(links.select(F.col("segment_id").alias("neighbor_id"), "ts", "delay"), ["neighbor_id", "ts"])
              .groupBy("segment_id", "ts").agg(F.sum("delay").alias("beside_delay")))
    at = (cases.join(own.drop("vc", "length_km"), ["segment_id", "ts"]).withColumn("keep", keep)
          .withColumn("r_cap", adjusted_capacity("o_cap", "keep"))
          .withColumn("r_time", link_hours("o_flow", "r_cap", "o_free_h", "o_cycle", "o_green"))
          .withColumn("r_delay", F.col("o_flow") * (F.col("r_time") - F.col("o_free_h")))
          .join(totals, "ts").join(beside, ["segment_id", "ts"], "left")
          .withColumns({"before_net": F.col("net_delay") - F.col("o_delay") + F.col("r_delay"),
                        "before_local": F.coalesce("beside_delay", F.lit(0.0)) + F.col("r_delay")})
          .select("segment_id", "ts", "state", "anomalous", "keep", "before_net", "before_local"))
    target = links.select(F.col("segment_id").alias("target_segment"), "ts", "flow", "cap", "free_h", "cycle", "green")
    most = candidates.agg(F.max("cost_index")).scalar()
    tries = tried.select("segment_id", "candidate_id", "target_segment", "hop", "relation", "intervention_type", "capacity_delta_vph",
                         "cost_index", "feasibility_band")
    out = (at.join(tries, "segment_id").join(target, ["target_segment", "ts"])
           .withColumn("cap_now", adjusted_capacity("cap", F.when(F.col("hop") == 0, F.col("keep")).otherwise(F.lit(1.0))))
           .withColumn("cap_new", adjusted_capacity("cap_now", None, "capacity_delta_vph"))
           .withColumns({"t_now": link_hours("flow", "cap_now", "free_h", "cycle", "green"),
                         "t_new": link_hours("flow", "cap_new", "free_h", "cycle", "green")})
           .withColumn("saved", F.col("flow") * (F.col("t_now") - F.col("t_new"))))
    return out.withColumns({
        "network_pct": F.when(F.col("before_net") != 0, F.col("saved") / F.col("before_net") * 100).otherwise(0.0),
        "local_pct": F.when(F.col("before_local") > 0, F.when(F.col("hop") <= 1, F.col("saved")).otherwise(0.0) / F.col("before_local") * 100).otherwise(0.0),
        "worsened_pct": F.when(F.col("t_new") > 1.01 * F.col("t_now"), 100.0 / n_segments).otherwise(0.0),
        "cost": F.col("cost_index") / most, "penalty": lookup("feasibility_band", conf.BAND_PENALTY)}).withColumn(
        "score", conf.SCORE_WEIGHTS["network"] * F.col("network_pct") + conf.SCORE_WEIGHTS["local"] * F.col("local_pct")
        - conf.SCORE_WEIGHTS["worsened"] * F.col("worsened_pct") - conf.SCORE_WEIGHTS["cost"] * F.col("cost") - F.col("penalty")).select(
        "segment_id", "ts", "state", "anomalous", "candidate_id", "target_segment", "hop", "relation", "intervention_type", "network_pct",
        "local_pct", "worsened_pct", "cost", "penalty", "score", F.col("before_local").alias("local_before"),
        (F.col("before_local") - F.when(F.col("hop") <= 1, F.col("saved")).otherwise(0.0)).alias("local_after"), F.col("saved").alias("saved_veh_h"))


def ranked(evaluated: DataFrame) -> DataFrame:
    order = Window.partitionBy("segment_id", "ts").orderBy(F.round("score", 9).desc(), "candidate_id")
    return evaluated.withColumn("rank", F.row_number().over(order))


def advice(cases: DataFrame, evaluated: DataFrame, ahead: DataFrame, spill: DataFrame, threshold: float, tolerance_veh_h: float = conf.SAVING_TOLERANCE_VEH_H) -> DataFrame:
    """Per case: no action, the best candidate, or an operational response; with a confidence and the reasons.
    ``cases`` holds (segment_id, ts, state, anomalous, cause, score, speed_ratio, confidence_label), ``ahead`` (segment_id, ts, rising),
    ``spill`` (segment_id, ts, at_risk)."""
    best = ranked(evaluated).filter("rank = 1").select(
        "segment_id", "ts", "candidate_id", "target_segment", "intervention_type", "relation", "hop", "network_pct", "local_pct",
        F.col("score").alias("candidate_score"), "saved_veh_h")
    improving = F.coalesce((F.col("network_pct") > 0) & (F.col("local_pct") > 0), F.lit(False))
    kind = F.when((F.col("state") == "NORMAL") & ~F.col("anomalous"), "none").when(improving, "candidate").otherwise("operational")
    base = F.when(F.col("anomalous"), lookup("confidence_label", {"LOW": 0, "MEDIUM": 1, "HIGH": 2}, 0)) \
        .when(F.col("state") != "NORMAL", 1).otherwise(2)
    chosen = F.col("kind") == "candidate"
    down = F.when(chosen & (F.col("hop") > 0), 1).otherwise(0) + F.when(chosen & (F.abs("saved_veh_h") < tolerance_veh_h), 1).otherwise(0)
    cases = cases.join(ahead, ["segment_id", "ts"], "left").join(spill, ["segment_id", "ts"], "left")
    return (cases.join(best, ["segment_id", "ts"], "left").withColumn("kind", kind)
            .withColumn("confidence", lookup(F.greatest(base - down, F.lit(0)), {0: "LOW", 1: "MEDIUM", 2: "HIGH"}))
            .withColumns({
                "headline": F.when(F.col("kind") == "none", "Leave as is")
                .when(chosen, F.format_string("Try %s %s at %s", F.replace("intervention_type", F.lit("_"), F.lit(" ")), "candidate_id", "target_segment"))
                .otherwise("Respond by operations"),
                "reasons": F.array_compact(F.array(
                    F.when(F.col("anomalous"), F.concat(F.lit("anomaly score "), decimals("score"), F.lit(f" of at least {threshold:g} ("), "cause", F.lit(")"))),
                    F.when(F.col("speed_ratio").isNotNull(), F.concat(F.lit("state "), "state", F.lit(", speed ratio "), decimals("speed_ratio"))).otherwise("no current reading"),
                    F.when(F.col("rising"), "more congestion ahead").when(~F.col("rising"), "no more congestion ahead"),
                    F.when(F.size("at_risk") > 0, F.concat(F.lit("may spill over to "), F.concat_ws(", ", "at_risk"))),
                    F.when(chosen, F.concat(F.lit("best feasible candidate ("), "relation", F.lit("), score "), decimals("candidate_score", 3)))
                    .when(F.col("kind") == "operational", F.when(F.col("candidate_id").isNull(), "no feasible candidate within reach")
                          .otherwise("no candidate reduced the delay")))),
                "limitations": F.array_compact(F.array(
                    F.lit("flows are taken as observed"), F.lit("a candidate adds its capacity to its target only"),
                    F.when(chosen & (F.col("hop") > 0), "no candidate targets this segment directly"),
                    F.when(chosen & (F.abs("saved_veh_h") < tolerance_veh_h), "the saving is within the noise of the figures")))})
            .withColumn("candidate_id", F.when(chosen, F.col("candidate_id"))))


def operational_options(cases: DataFrame, ways: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of what can be done at once: prepare a diversion, investigate, monitor.
    ``ways`` are detours (blocked_id, path, cost_hours) of the bucket column ``bucket`` that the cases carry."""
    direct = segments.select("segment_id", (F.col("length_km") / F.col("free_flow_speed_kmh") * 60).alias("direct_min"))
    blocked = F.col("state").isin("HEAVY", "CRITICAL") | F.col("anomalous")
    detour = (cases.filter(blocked).join(ways.withColumnRenamed("blocked_id", "segment_id"), ["segment_id", "bucket"]).join(direct, "segment_id")
              .select("segment_id", "ts", F.lit("Prepare diversion").alias("action"),
                      F.concat_ws(">", "path").alias("detail"), (F.col("cost_hours") * 60).alias("detour_min"), "direct_min"))
    none = F.lit(None).cast("double")
    look = cases.filter("anomalous").select("segment_id", "ts", F.lit("Investigate").alias("action"),
                                            F.format_string("cause %s, confidence %s", "cause", "confidence_label").alias("detail"),
                                            none.alias("detour_min"), none.alias("direct_min"))
    watch = cases.filter(F.col("anomalous") | (F.col("state") != "NORMAL")).select(
        "segment_id", "ts", F.lit("Monitor").alias("action"), F.lit("re-evaluate on the next reading").alias("detail"),
        none.alias("detour_min"), none.alias("direct_min"))
    return detour.unionByName(look).unionByName(watch)
