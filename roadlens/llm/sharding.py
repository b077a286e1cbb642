"""Sharding by jump consistent hashing, in DataFrame functions only.

The generator of the published algorithm multiplies unsigned 64-bit numbers with wrap-around; SQL longs refuse to overflow, so the state is
kept as two 32-bit halves. One pass gives the shard for ``n`` and for ``n + 1`` shards: a key either stays or goes to the new shard.

Slots (gapless from 0 within a shard) are ranks within (shard, bucket) plus the sizes of the shard's earlier buckets. Buckets are a hash of
the row, so no task ranks a whole shard, and shards of any size stay even.

Defined cases: a null key is the key 0; a null text has no bytes (size 1, checksum 0); repeated rows get slots of their own; empty input
gives an empty result; names of further columns do not matter, since only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written
from .text import read

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
HIGH, LOW, MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
LAW = "key"


def _next(state: Column) -> tuple[Column, Column]:
    """(high, low) halves of key * MULTIPLIER + 1 modulo 2**64; every product below stays under 2**63."""
    h, l = state["high"], state["low"]
    cut = lambda c: c.bitwiseAND(F.lit(MASK))
    short = lambda c: c.bitwiseAND(F.lit(0xFFFF))
    up = F.shiftrightunsigned(l, 16) * F.lit(LOW)
    low = short(l) * F.lit(LOW) + F.shiftleft(short(up), 16) + F.lit(1)
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(up, 16)
    high = carry + short(h) * F.lit(LOW) + F.shiftleft(short(F.shiftrightunsigned(h, 16) * F.lit(LOW & 0xFFFF)), 16) + l * F.lit(HIGH)
    return cut(high), cut(low)


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a 64-bit key among ``shards``, and among one more.

    A key jumps about ln(shards) times and at most ``shards`` times; beyond 256 jumps (less likely than any hardware fault) the query
    fails rather than give a wrong shard.
    """
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(long(MASK)).alias("low"), long(-1).alias("b"), long(0).alias("j"))

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state)
        draw = (F.shiftrightunsigned(high, 1) + long(1)).cast("double")
        onward = F.struct(high.alias("high"), low.alias("low"), state["j"].alias("b"),
                          F.floor((state["j"] + long(1)).cast("double") * (F.lit(2147483648.0) / draw)).cast("long").alias("j"))
        return F.when(state["j"] < long(shards), onward).otherwise(state)

    def finish(state: Column) -> Column:
        shard = F.when(state["j"] < long(shards), F.raise_error(F.lit("jump hash did not settle")).cast("long")).otherwise(state["b"])
        return F.struct(shard.cast("int").alias("shard"), F.when(state["j"] == long(shards), long(shards)).otherwise(state["b"]).cast("int").alias("grown"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, 256))), start, step, finish)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 512) -> DataFrame:
    """``name``: a gapless number from 0 within ``keys``. Ranks are taken per bucket of rows, so a group of any size is spread.

    ``df`` must give the same rows each time it is read (a written table): it is counted and then ranked.
    """
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "_bucket", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return own.join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_rank")).drop("_bucket", "_before", "_rank")


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    at = jump(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), shards)
    rows = docs.select(F.col("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), at.alias("at"))
    rows = written(rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard")),
                   "shards")
    return ranked(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot") \
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents"), 16)
