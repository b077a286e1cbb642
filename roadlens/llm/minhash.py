"""Near-duplicate documents by min-max hashing: both ends of every permutation count.

A document is the set of its distinct word shingles. A permutation gives two values of a set, the smallest and the largest hash; each agrees
between two sets with a probability equal to their Jaccard similarity, so ``BANDS * ROWS`` values need only half as many permutations. The values
of ``ROWS`` permutations form two bands, one of minima and one of maxima. An element that only one set holds can be one end of a permutation
but hardly both, so the two bands of the same permutations fail together less often than independent ones would: the estimate stays unbiased and
its variance falls. With 32 bands of 7 rows a pair at 0.85 shares no band with a probability below 5 in a million, one at 0.95 below 1e-16.

Steps, over written tables:
 1. signatures: one pass over the texts gives set size, fingerprint (128 bits) and the band keys; equal sets become one representative;
 2. buckets: a band key that several representatives have joins each to the bucket's first one, so a bucket of any size gives one row per member.
    Counting and finding the first are partial aggregates, and the join back is on two long numbers: a key of very many members is split by AQE;
 3. verification on full sets, for every pair that meets in a bucket and is not connected already (:func:`ngram_join.confirmed`), then classes
    by label propagation.

Rows: null and empty texts have no shingles, their own doc_id as class, and stay. Equal sets share a class. A row without doc_id gets its class's
smallest doc_id, or null where no member has one. Rows may repeat; empty input gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import written
from .ngram_join import checking_sql, classes, confirmed
from .text import WordHashes, column, mapped, mixed, read, shingle_set, words

BANDS, ROWS = 32, 7
BLOCK = 1 << 10

_numbers = np.random.default_rng(20240501).integers(1, 2**63, (2, BANDS // 2 * ROWS), dtype=np.uint64)
ADDED, FACTORS = _numbers[0], _numbers[1] | np.uint64(1)
_ROW_FACTORS = np.random.default_rng(77).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a non-empty set under each permutation (add, multiply by an odd number, mix: all bijections)."""
    low, high = np.full(len(ADDED), 2**64 - 1, np.uint64), np.zeros(len(ADDED), np.uint64)
    for k in range(0, len(shingles), BLOCK):
        values = (shingles[k:k + BLOCK, None] ^ ADDED) * FACTORS
        values ^= values >> np.uint64(32)
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    return low, high


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One number per band: minima of the first permutations, maxima of the same ones, and so on."""
    ends = np.stack(signature(shingles)).reshape(2, BANDS // 2, ROWS)
    return mixed((ends * _ROW_FACTORS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64).reshape(2, -1)).ravel()


def estimate(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Estimated Jaccard similarity: the share of equal ends of both kinds."""
    return float(np.mean([a == b for a, b in zip(x, y)]))


def least_size(percent: int) -> int:
    """Sets smaller than this are similar to equal ones only: one more element already is too much."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, print (null for the empty set) and bands of each row."""
    hashes, least = WordHashes(), least_size(percent)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(hashes.of(words(t.as_py())), size) for t in batch.column("text")]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands = [band_keys(s).view(np.int64) if len(s) >= least else np.empty(0, np.int64) for s in sets]
            ends = np.cumsum([0] + [len(b) for b in bands])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *bands]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), listed],
                                             ["doc_id", "n", "print", "bands"])
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, n long, print binary, bands array<long>")


def representatives(rows: DataFrame) -> DataFrame:
    """ref, print, doc_id (the smallest) and bands of each distinct set, numbered once and written."""
    one = rows.filter("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    return written(one.select(F.monotonically_increasing_id().alias("ref"), "print", "doc_id", "bands"), "minhash-representatives")


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b, pivot): the first member ``a`` of a bucket with each other member ``b``, once."""
    keys = written(reps.select("ref", F.explode("bands").alias("key")), "minhash-keys")
    buckets = keys.groupBy("key").agg(F.min("ref").alias("a"), F.max("ref").alias("last")).filter("a < last")
    met = keys.join(buckets.select("key", "a"), "key").filter("ref <> a")
    return written(met.groupBy("a", F.col("ref").alias("b")).agg(F.lit(True).alias("pivot")), "minhash-candidates")


def deduplicated(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    rows = written(signed(docs, size, percent), "minhash-rows")
    reps = representatives(rows)
    root = classes(confirmed(docs, reps, candidates(reps), size, percent))
    at = reps.select("ref", "print", "doc_id").join(root, "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    least = at.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classed = written(at.join(least, "root").select("print", "component_id"), "minhash-classes")
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), "print").join(classed, "print", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = checking_sql(3, 85, ", t.doc_id IS NOT DISTINCT FROM m.component_id AS kept")
