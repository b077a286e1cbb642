"""Live analysis as Structured Streaming jobs over a stream of readings (ts, segment_id, ingest_seq, measures)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..conf import VALUE_COLUMNS, Settings
from ..operators.detect import network_shift
from ..sources.workspace import shipped

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay)


def first_arrivals(stream: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Later copies of a (segment, slot) are dropped as long as the watermark remembers it."""
    return watermarked(stream, delay).dropDuplicatesWithinWatermark(["segment_id", "ts"])


def slot_means(stream: DataFrame, cfg: Settings, delay: str = "15 minutes") -> DataFrame:
    """Mean speed and flow per segment and slot, final once the watermark has passed the slot."""
    return (watermarked(stream, delay).groupBy(F.window("ts", f"{cfg.step_minutes} minutes"), "segment_id")
            .agg(F.count("*").alias("readings"), F.avg("speed_kmh").alias("speed_kmh"), F.avg("flow_vph").alias("flow_vph"))
            .select("segment_id", F.col("window.start").alias("slot"), "readings", "speed_kmh", "flow_vph"))


def trailing_quality(stream: DataFrame, cfg: Settings, delay: str = "15 minutes") -> DataFrame:
    """Share of good readings per segment over the trailing quality window, one result per slot."""
    good = ((F.col("speed_kmh") >= 0) & (F.col("sensor_quality") >= 0.5)).cast("double")
    span = f"{cfg.step_minutes * cfg.quality_slots} minutes"
    return (watermarked(stream, delay).groupBy(F.window("ts", span, f"{cfg.step_minutes} minutes"), "segment_id")
            .agg(F.sum(good).alias("good"), F.count("*").alias("readings"))
            .select("segment_id", F.col("window.end").alias("until"), "readings", (F.col("good") / F.col("readings")).alias("quality")))


def ongoing_events(flagged: DataFrame, cfg: Settings, delay: str = "15 minutes") -> DataFrame:
    """Runs of flagged slots per segment: slots that touch merge into one session."""
    return (watermarked(flagged, delay).groupBy(F.session_window("ts", f"{cfg.step_minutes} minutes"), "segment_id")
            .agg(F.count("*").alias("slots"), F.max("score").alias("peak_score"))
            .select("segment_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("until"), "slots", "peak_score"))


READING = ("ingest_seq", *VALUE_COLUMNS, "sensor_quality", "free_flow_speed_kmh", "capacity_vph")


def _carried(known: np.ndarray) -> np.ndarray:
    """Place of the last value that is there, at or before each place; -1 before the first."""
    return np.maximum.accumulate(np.where(np.isnan(known), -1, np.arange(len(known))))


def judged_in_order(rows: pd.DataFrame, last: dict | None, step: int, fill_slots: int) -> tuple[pd.DataFrame, dict]:
    """Slots of one segment in time order (``at`` in seconds, READING columns), judged and filled after the state ``last``; also the new state.

    The state is put before the rows as one more row, so that shifts, repeat runs and fills are the same column operations for all of them.
    """
    last = last or {"at": None, "repeats": 0}
    seed = lambda name: np.nan if last.get(name) is None else float(last[name])
    measures = ("speed_kmh", "flow_vph", "occupancy_pct")
    at = np.append(seed("at"), rows["at"].to_numpy(np.float64))
    v = {c: np.append(seed(c) if c in measures else np.nan, rows[c].to_numpy(np.float64)) for c in READING[1:]}
    before = lambda x: np.append(np.nan, x[:-1])
    with np.errstate(invalid="ignore"):
        adjacent = at - before(at) == step
        same = adjacent & np.all([v[c] == before(v[c]) for c in measures], axis=0)
        place = np.arange(len(at))
        opened = np.maximum.accumulate(np.where(same, 0, place))
        repeats = place - opened + np.where(same & (opened == 0), last["repeats"], 0)
        prior = np.where(adjacent, before(v["flow_vph"]), np.nan)
        bad = (np.any([v[c] < 0 for c in VALUE_COLUMNS], axis=0) | (v["speed_kmh"] > 1.5 * v["free_flow_speed_kmh"]) | (v["occupancy_pct"] > 100)
               | (v["congestion_index"] > 1) | (v["flow_vph"] > 2.5 * v["capacity_vph"]) | ((v["flow_vph"] > 3 * prior + 300) & (v["flow_vph"] > v["capacity_vph"]))
               | ((repeats >= 3) & ~((v["occupancy_pct"] >= 97) | (v["flow_vph"] <= 0))) | (v["sensor_quality"] < 0.5))
        state, filled, out = {}, np.zeros(len(at), bool), {}
        for c in VALUE_COLUMNS:
            good = np.where(bad, np.nan, v[c])
            good[0] = seed(f"good_{c}")
            since = np.where(np.isnan(good), np.nan, at)
            since[0] = seed(f"good_{c}_at")
            held = _carried(good)
            known, when = (np.where(held < 0, np.nan, x[held]) for x in (good, since))
            out[c] = np.where(at - when <= fill_slots * step, known, np.nan)
            filled |= np.isnan(good) & ~np.isnan(out[c])
            state |= {f"good_{c}": known[-1], f"good_{c}_at": when[-1]}
    state |= {"at": at[-1], "repeats": int(repeats[-1]), **{c: v[c][-1] for c in measures}}
    result = pd.DataFrame({"at": rows["at"].to_numpy(), "ingest_seq": rows["ingest_seq"].to_numpy(), **{c: x[1:] for c, x in out.items()},
                           "valid": (~bad & ~np.isnan(v["speed_kmh"]))[1:], "filled": filled[1:]})
    return result, {k: None if np.isnan(x) else x for k, x in state.items()}


WAITING = np.dtype([("at", "<i8"), ("ingest_seq", "<i8"), *[(c, "<f8") for c in READING[1:]]])


class Sanitiser(StatefulProcessor):
    """Per segment: slots wait, first arrival first, until the watermark has passed them; then they are judged in the order of time.

    So slots may come in any order within the lateness. A reading that comes after its slot was judged changes nothing and is counted; the
    count goes out with the next slot. What waits is bounded by the lateness, whatever a sensor sends.

    All state of a segment is one value, the waiting slots packed in it: it is read and written once per batch and once per expiry. One timer stands
    for all that waits, at the earliest slot.
    """

    OUTPUT = ("segment_id string, ts timestamp, ingest_seq long, " + ", ".join(f"{c} double" for c in VALUE_COLUMNS) + ", valid boolean, filled boolean, late long")

    def __init__(self, step_seconds: int, fill_slots: int):
        self.step_seconds, self.fill_slots = step_seconds, fill_slots
        self.names = ("at", "repeats", "speed_kmh", "flow_vph", "occupancy_pct", *[x for c in VALUE_COLUMNS for x in (f"good_{c}", f"good_{c}_at")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "waiting binary, timer long, late long, at long, repeats int, " + ", ".join(f"{n} double" for n in self.names[2:]))

    def _read(self) -> tuple[np.ndarray, int | None, int, dict | None]:
        held = self.state.get()
        if held is None:
            return np.empty(0, WAITING), None, 0, None
        last = dict(zip(self.names, held[3:]))
        return np.frombuffer(bytes(held[0]), WAITING), held[1], held[2], last if last["at"] is not None else None

    def _write(self, waiting: np.ndarray, timer: int | None, late: int, last: dict | None) -> None:
        """Stores the state, and sets a timer for the earliest slot if none is set for it or before it."""
        first = int(waiting["at"].min()) if len(waiting) else None
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first * 1000)
            timer = first
        last = last or {n: None for n in self.names}
        self.state.update((waiting.tobytes(), timer, late, *[None if last[n] is None else int(last[n]) if n in ("at", "repeats") else float(last[n]) for n in self.names]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, timer, late, last = self._read()
        found = [waiting]
        for batch in rows:
            more = np.empty(len(batch), WAITING)
            more["at"] = batch["ts"].to_numpy("datetime64[s]").astype(np.int64)
            for c in READING:
                more[c] = batch[c].to_numpy(more[c].dtype)
            if last is not None:
                late += int((more["at"] <= last["at"]).sum())
                more = more[more["at"] > last["at"]]
            found.append(more)
        every = np.concatenate(found)
        every = every[np.lexsort((every["ingest_seq"], every["at"]))]
        self._write(every[np.append(True, every["at"][1:] != every["at"][:-1])[:len(every)]], timer, late, last)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        waiting, timer, late, last = self._read()
        ready, rest = waiting[waiting["at"] <= passed], waiting[waiting["at"] > passed]
        if not len(ready):  # an earlier timer of this batch has taken them
            yield pd.DataFrame()
            return
        out, last = judged_in_order(pd.DataFrame({n: ready[n] for n in WAITING.names}), last, self.step_seconds, self.fill_slots)
        self._write(rest, None, late, last)
        out = out.assign(segment_id=key[0], ts=out["at"].to_numpy().astype("datetime64[s]").astype("datetime64[ns]"), late=late)
        yield out[["segment_id", "ts", "ingest_seq", *VALUE_COLUMNS, "valid", "filled", "late"]]

    def close(self) -> None:
        pass


def sanitised(stream: DataFrame, segments: DataFrame, cfg: Settings, delay: str = "15 minutes") -> DataFrame:
    """Readings judged and filled in the order of time, once the watermark has passed a slot. Needs the RocksDB state store (``enable_state``)."""
    shipped(stream.sparkSession)
    rows = watermarked(stream, delay).join(segments.select("segment_id", "free_flow_speed_kmh", "capacity_vph"), "segment_id")
    return rows.groupBy("segment_id").transformWithStateInPandas(
        statefulProcessor=Sanitiser(cfg.step_seconds, cfg.fill_slots), outputStructType=Sanitiser.OUTPUT, outputMode="Append", timeMode="EventTime")


def enable_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_baseline(stream: DataFrame, segments: DataFrame, baseline: DataFrame, context: DataFrame) -> DataFrame:
    """Stream-static join: the drop of every reading against what is normal for its segment, hour and day type."""
    static = segments.select("segment_id", "free_flow_speed_kmh")
    holidays = context.filter("holiday_flag > 0").select("ts", F.lit(True).alias("is_holiday"))
    rows = stream.join(static, "segment_id").join(holidays, "ts", "left").withColumns({
        "hour": F.hour("ts").cast("long"), "daytype": ((F.weekday("ts") >= 5) | F.coalesce("is_holiday", F.lit(False))).cast("long"),
        "speed_ratio": F.col("speed_kmh") / F.col("free_flow_speed_kmh")})
    return (rows.join(baseline.select("segment_id", "hour", "daytype", "sr_med"), ["segment_id", "hour", "daytype"], "left")
            .select("segment_id", "ts", "speed_ratio", (F.col("sr_med") - F.col("speed_ratio")).alias("drop")))


def score_batches(drops: DataFrame, path: str, checkpoint: str):
    """Network-wide shift and local drop per micro-batch. The shift needs all segments of a slot: feed it closed slots
    (:func:`slot_means`), which leave the watermark together and so arrive in one batch. A repeated batch replaces its own output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        scored = batch.join(network_shift(batch), "ts", "left").withColumn("local_drop", F.coalesce(F.col("drop") - F.col("net_shift"), F.lit(0.0)))
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return drops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a streaming result to Parquet, processing what is available and stopping."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
