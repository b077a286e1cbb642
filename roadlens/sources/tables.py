"""Reading, writing and registering the base tables."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import Settings
from ..functions import slots
from .workspace import shipped

_READINGS = ("timestamp TIMESTAMP, segment_id STRING, source_node STRING, target_node STRING, speed_kmh DOUBLE, flow_vph DOUBLE, "
             "occupancy_pct DOUBLE, travel_time_min DOUBLE, free_flow_time_min DOUBLE, delay_min DOUBLE, queue_length_veh DOUBLE, "
             "congestion_index DOUBLE, sensor_quality DOUBLE")
_TARGETS = "timestamp TIMESTAMP, segment_id STRING, " + ", ".join(
    f"target_{m}_{h}m DOUBLE" for h in (15, 30, 45, 60) for m in ("speed", "flow", "congestion"))
_CONTEXT = ("timestamp TIMESTAMP, temperature_c DOUBLE, rain_intensity DOUBLE, event_level BIGINT, event_id STRING, holiday_flag BIGINT, "
            "day_of_week BIGINT, hour DOUBLE")
_INCIDENTS = ("incident_id STRING, start_time TIMESTAMP, end_time TIMESTAMP, segment_id STRING, incident_type STRING, severity BIGINT, "
              "lanes_blocked BIGINT")
_ROADWORKS = ("work_id STRING, segment_id STRING, start_time TIMESTAMP, end_time TIMESTAMP, closure_fraction DOUBLE, work_type STRING")

# The schema of every base table.
SCHEMAS = {
    "network": "segment_id STRING, source_node STRING, target_node STRING, road_class STRING, lanes BIGINT, free_flow_speed_kmh DOUBLE, "
               "capacity_vph DOUBLE, length_km DOUBLE, grade_pct DOUBLE, signal_id STRING, structural_bottleneck BIGINT, "
               "importance DOUBLE, peak_capacity_factor DOUBLE",
    "nodes": "node_id STRING, x BIGINT, y BIGINT, lat DOUBLE, lon DOUBLE",
    "signal_plans": "signal_id STRING, node_id STRING, cycle_s BIGINT, green_ratio DOUBLE, offset_s BIGINT",
    "turn_restrictions": "node_id STRING, from_segment STRING, to_segment STRING, restriction STRING",
    "od_demand_profiles": "od_id STRING, origin_node STRING, destination_node STRING, base_demand_vph BIGINT, purpose STRING",
    "planning_candidates": "candidate_id STRING, target_segment STRING, intervention_type STRING, capacity_delta_vph BIGINT, "
                           "cost_index BIGINT, feasibility_band STRING",
    "scenario_examples": "scenario_id STRING, scenario_type STRING, start_time TIMESTAMP, end_time TIMESTAMP, target_segment STRING, "
                         "incident_type STRING, severity BIGINT, candidate_interventions STRING",
    "evaluation_windows": "scenario_id STRING, window_start TIMESTAMP, window_end TIMESTAMP, required_outputs STRING",
    **{f"traffic_{s}": _READINGS for s in ("train", "validation", "test")},
    **{f"forecast_targets_{s}": _TARGETS for s in ("train", "validation")},
    **{f"context_{s}": _CONTEXT for s in ("train", "validation", "test")},
    **{f"incidents_{s}": _INCIDENTS for s in ("train", "validation")},
    **{f"roadworks_{s}": _ROADWORKS for s in ("train", "validation", "test")},
}
# Tables a caller may ask for by name; traffic and labels are only reached through the range scan and the evaluation.
SMALL_TABLES = frozenset(SCHEMAS) - {n for n in SCHEMAS if n.startswith(("traffic_", "forecast_targets_"))}


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A raw CSV file with its declared schema; a row that does not fit fails the job instead of turning into NULLs."""
    return (spark.read.option("header", True).option("mode", "FAILFAST").option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
            .schema(SCHEMAS[name]).csv(path))


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    """Idempotent columnar copy."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def register(spark: SparkSession, directory: str, names) -> None:
    """One view per Parquet directory. Running it again replaces the views, so rows never accumulate."""
    for name in names:
        spark.read.parquet(f"{directory}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, name: str) -> DataFrame:
    """A small table by name, from the allow-list."""
    if name not in SMALL_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.table(name)


def range_scan(splits: list, start: str, end: str) -> DataFrame:
    """Rows between two times (both included) from splits that do not overlap; the filter reaches every scan."""
    kept = [s.filter(F.col("ts").between(slots.at(start), slots.at(end))) for s in splits]
    return reduce(DataFrame.unionByName, kept)


def network_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows two network tables do not share."""
    b = b.select(*a.columns)
    return a.subtract(b).unionByName(b.subtract(a)).agg(F.count("*").alias("differing_rows"))


def assert_same_network(a: DataFrame, b: DataFrame) -> None:
    differing = network_difference(a, b).first()["differing_rows"]
    if differing:
        raise ValueError(f"the new split was recorded on another network: {differing} differing rows")


def import_split(root: str, split: str, rows: DataFrame, network: dict, cfg: Settings) -> DataFrame:
    """Adds or replaces one split of the readings below ``root``, if it was recorded on the same network.

    ``network`` holds (known, new) per network table; they are compared in all columns. A split on another network is refused and nothing is written.
    Otherwise the rows are staged, partitioned by period, and only then take the place of the split's former ones: a job that fails half-way leaves the
    split as it was, other splits are not touched, and importing twice changes nothing. Returns one row (split, status, rows, differing_rows).
    """
    spark = rows.sparkSession
    differing = {name: network_difference(known, new).first()["differing_rows"] for name, (known, new) in network.items()}
    if any(differing.values()):
        return spark.createDataFrame([(split, "refused", 0, sum(differing.values()))], "split string, status string, rows long, differing_rows long")
    staged, place = f"{root}/_staged-{uuid.uuid4().hex[:12]}", f"{root}/split={split}"
    rows.withColumn(slots.PERIOD, slots.period("ts", cfg)).write.mode("error").partitionBy(slots.PERIOD).option("compression", "zstd").parquet(staged)
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(place), True)
    if not files.rename(path(staged), path(place)):
        raise OSError(f"could not move {staged} to {place}")
    n = spark.read.schema(rows.schema).parquet(place).count()
    return spark.createDataFrame([(split, "imported", n, 0)], "split string, status string, rows long, differing_rows long")


def splits(spark: SparkSession, root: str) -> DataFrame:
    """All imported splits; ``split`` and the period are directories, so a reader skips what it does not ask for."""
    return spark.read.parquet(root)


def overlapping_splits(rows: DataFrame) -> DataFrame:
    """(split, first, last, overlaps): whether a split begins before one that starts earlier has ended. One row per split is all that is ordered."""
    spans = rows.groupBy("split").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    before = Window.partitionBy(F.lit(0)).orderBy("first", "split").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("overlaps", F.coalesce(F.max("last").over(before) >= F.col("first"), F.lit(False)))


# Fixed value: files that Spark's text reader would unpack.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz|passthrough)$"
CHUNK_BYTES = 1 << 16


def _chunks(batches):
    """Lines (path, start, size, value) of one part of a file after another as numbered chunks; each line ends with its newline again."""
    at, number = None, 0
    for batch in batches:
        path, start, size = (batch.column(c).to_pylist() for c in ("path", "start", "size"))
        lines, first = batch.column("value").to_pylist(), 0
        while first < len(lines):
            key, end = (path[first], start[first]), first + 1
            while end < len(lines) and start[end] == key[1] and path[end] == key[0]:
                end += 1
            if key != at:
                at, number = key, 0
            data = b"\n".join(lines[first:end]) + b"\n"
            cut = [data[k:k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]
            n = len(cut)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()),
                                              pa.array([size[first]] * n, pa.int64()), pa.array(cut, pa.binary())], ["path", "start", "number", "size", "data"])
            number, first = number + n, end


def _digest(path: str, size: int, total: int, plain, marked) -> str:
    """The hash of a file of which ``total`` bytes were read, its last newline (held back so far) included."""
    if size - total not in (0, -1, 3, 2):
        raise ValueError(f"read {total} bytes of {path}, which has {size}")
    found = plain if size <= total else marked  # the reader drops a byte order mark
    if size - total in (0, 3):
        found.update(b"\n")
    return found.hexdigest()


def _digests(batches):
    """(path, sha256) from chunks in the order of their file; what is held is one chunk and the state of the hash."""
    path = size = total = plain = marked = None
    for batch in batches:
        out = []
        for p, s, data in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), batch.column("data")):
            data = data.as_buffer()
            if p != path:
                if path is not None:
                    out.append((path, _digest(path, size, total, plain, marked)))
                path, size, total, plain, marked, held = p, s, 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf"), b""
            last = data[-1:].to_pybytes() if data.size else b""
            now = memoryview(data)[:-1] if last == b"\n" else memoryview(data)
            for h in (plain, marked):
                h.update(held)
                h.update(now)
            held, total = last if last == b"\n" else b"", total + data.size
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["path", "sha256"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([_digest(path, size, total, plain, marked)])], ["path", "sha256"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file below a directory, however large.

    A file is read in parts by many tasks, line by line and byte for byte; its chunks are sorted (which spills) and then hashed in order by one
    task, since SHA-256 cannot be put together from parts. Only compressed files, which Spark's text reader would unpack, are read as a whole.
    """
    shipped(spark)
    reader = lambda: spark.read.option("recursiveFileLookup", True)
    files = reader().format("binaryFile").load(path).withColumn("key", F.col("_metadata.file_path"))
    packed = F.col("_metadata.file_name").rlike(PACKED)
    lines = reader().option("lineSep", "\n").text(path).filter(~packed).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"))
    chunks = lines.mapInArrow(_chunks, "path string, start long, number long, size long, data binary")
    ordered = chunks.repartition("path").sortWithinPartitions("path", "start", "number")
    whole = files.filter(packed).select("key", F.sha2("content", 256).alias("sha256"))
    found = ordered.mapInArrow(_digests, "path string, sha256 string").withColumnRenamed("path", "key").unionByName(whole)
    return files.select("path", "key", "length").join(found, "key", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        # a byte order mark alone has no line
        F.coalesce("sha256", F.when(F.col("length") == 3, F.sha2(F.lit(b"\xef\xbb\xbf"), 256))).alias("sha256"), F.col("length").alias("bytes"))


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that were added, removed or changed since the stored checksums."""
    before = stored.select("file", F.col("sha256").alias("stored_sha256"))
    return (now.select("file", "sha256").join(before, "file", "full_outer")
            .withColumn("status", F.when(F.col("stored_sha256").isNull(), "added").when(F.col("sha256").isNull(), "removed")
                        .when(F.col("sha256") != F.col("stored_sha256"), "changed"))
            .filter(F.col("status").isNotNull()).select("file", "status"))
