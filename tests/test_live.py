"""The streaming sanitiser over several batches, out of order, against the batch panel."""

import random

import numpy as np
import pandas as pd
import pytest
from test_operators import COLS, HOUR, at, readings

from roadlens.operators import panel
from roadlens.streaming import live


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"at": np.cumsum(rng.choice([300, 300, 300, 600], n)), "ingest_seq": range(n)})
    for c in live.READING[1:]:
        rows[c] = rng.choice([10.0, 20.0, 30.0, np.nan, -1.0], n, p=[0.4, 0.3, 0.2, 0.05, 0.05])
    rows = rows.assign(sensor_quality=1.0, free_flow_speed_kmh=60.0, capacity_vph=100.0, congestion_index=0.5)
    rows.loc[10:16, ["speed_kmh", "flow_vph", "occupancy_pct"]] = [20.0, 30.0, 10.0]
    return rows


@pytest.mark.parametrize("size", [1, 2, 5, 7])
def test_batches_do_not_matter(size):
    rows = rows_of(80, 3)
    whole, _ = live.judged_in_order(rows, None, 300, 3)
    state, parts = None, []
    for i in range(0, len(rows), size):
        out, state = live.judged_in_order(rows.iloc[i:i + size].reset_index(drop=True), state, 300, 3)
        parts.append(out)
    pd.testing.assert_frame_equal(pd.concat(parts).reset_index(drop=True).astype(float), whole.reset_index(drop=True).astype(float))
    assert 0 < whole.valid.sum() < len(rows) and whole.filled.any()


def test_stream_in_any_order_equals_the_panel(spark, tmp_path):
    segs = spark.createDataFrame([(f"R{s}", 50.0, 1000.0) for s in range(3)], "segment_id string, free_flow_speed_kmh double, capacity_vph double")
    rng, rows = random.Random(6), readings(n_slots=12)
    rows = [r if rng.random() > 0.1 else (*r[:3], -r[3], *r[4:]) for r in rows]
    rows += [(r[0], r[1], r[2] + 50_000, r[3] + 9, *r[4:]) for r in rng.sample(rows, 20)]
    # slots 0 and 10 minutes come first, then 5 and 15, and so on; copies come with their slot
    batch = lambda r: slot(r) // 4 * 2 + slot(r) % 2
    slot = lambda r: int((r[1] - at(0)).total_seconds()) // 300
    for b in sorted({batch(r) for r in rows}):
        part = spark.createDataFrame([r for r in rows if batch(r) == b], COLS)
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{b:03d}")
    late = [("R0", at(10), 999_999, 1.0, 1.0, 1.0, 0.1, 1.0, 0.2, 1.0)]
    live.enable_state(spark)
    # one folder is one batch: the source is read folder by folder, in order
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    for step, b in enumerate([*sorted({batch(r) for r in rows}), "late"]):
        if b == "late":
            spark.createDataFrame(late, COLS).coalesce(1).write.parquet(f"file://{tmp_path}/feed/late")
        else:
            spark.read.parquet(f"file://{tmp_path}/in/{b:03d}").coalesce(1).write.parquet(f"file://{tmp_path}/feed/{step:03d}")
        stream = spark.readStream.schema(COLS).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/feed")
        live.to_table(live.sanitised(stream, segs, HOUR), out, check).awaitTermination()
    got = {(r.segment_id, r.ts): (r.speed_kmh, r.flow_vph, r.valid) for r in spark.read.parquet(out).collect()}
    want = {(r.segment_id, r.ts): (r.speed_kmh, r.flow_vph, r.valid) for r in panel.sanitized(spark.createDataFrame(rows, COLS), segs, HOUR).collect() if r.ts <= at(5 * 11 - 15)}
    assert got == want, (sorted(got.items() - want.items())[:4], sorted(want.items() - got.items())[:4], len(got), len(want))
