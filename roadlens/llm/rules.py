"""Quality rules with adaptive thresholds.

Every document gets counts from its whole text. Each ratio of those counts is summarised per (language, source) in a sketch with
logarithmic buckets: counts per bucket, which merge by addition in any order, so the result does not depend on the partitioning and a
source with a third of all rows is summed within tasks before the shuffle. Thresholds come from the sketches' quantiles, on a scale on which
shares (square root) and lengths (logarithm) spread evenly:

    centre +/- max(REACH * spread, noise)

The spread is taken on the side away from the fault (the low tail for a ratio that only junk raises, the upper quartile where even the
centre is zero), so junk does not widen its own fence; documents that fail the base rule are left out. A source's threshold is pulled
towards its language's while the source is small, and never goes beyond twice, or below half, the language's margin. Thresholds are
written, then joined back by (language, source). A document is at fault when its count is beyond the limit times its size by more than a
few events, which is what one telephone number, one long word or one sentence said twice does to a short text.

Defined cases: a null or empty text has zero counts and fails the base rule; null language or source form groups of their own; repeated
rows are judged one by one; empty input gives an empty result; all input columns travel in the struct ``doc``, so no name can clash.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written
from .measures import COUNTS, counts
from .text import WordHashes, column, mapped, read

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FLOOR, GROWTH = 1e-4, 1.02
REACH, TAIL, QUARTER, CENTRE = 8.0, 0.05, 0.75, 0.5
NORMAL = {TAIL: 1.645, QUARTER: 0.674}  # distance of these quantiles from the centre in standard deviations
SMALL_GROUP = 50.0
LEAST_WORDS = 10
SHORT_EVENTS = 15  # characters that ten short words may lack
# count, size, side of the fault, noise (least margin on the ratio's scale), events allowed on top
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars", "high", 0.07, 1),
    "upper_share": ("n_upper", "n_upper + n_lower", "high", 0.10, 8),
    "mark_share": ("n_marks", "word_chars", "high", 0.10, 8),
    "repeat_share": ("n_repeat_words", "n_words", "high", 0.22, 30),
    "dup_line_share": ("n_dup_lines", "n_lines", "high", 0.30, 2),
    "adjacent_share": ("n_adjacent", "n_words", "high", 0.15, 2),
    "word_length": ("word_chars", "n_words", "both", 0.20, 40),
}


def scaled(ratio, x):
    """``x`` on the scale of its ratio."""
    return F.when(ratio == "word_length", F.log(F.greatest(x, F.lit(FLOOR)))).otherwise(F.sqrt(x))


def unscaled(ratio, t):
    return F.when(ratio == "word_length", F.exp(t)).otherwise(F.pow(F.greatest(t, F.lit(0.0)), F.lit(2)))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``keep``, all by default), ``lang``, ``source`` and the counts of every text."""
    keep = docs.columns if keep is None else keep
    fields = [f for f in docs.schema.fields if f.name in keep]
    packed = docs.select(F.struct(*[column(docs, f.name) for f in fields]).alias("doc"), F.col("text"),
                         F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    kind = packed.schema["doc"].dataType.simpleString()
    hashes = WordHashes()

    def run(batches):
        for batch in batches:
            values = [counts(t.as_py(), hashes) for t in batch.column("text")]
            found = [pa.array(v, pa.int64()) for v in (zip(*values) if values else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("lang"), batch.column("source"), *found],
                                             ["doc", "lang", "source", *COUNTS])
    return mapped(packed, run, f"doc {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_rule():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketched(df: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): one mergeable sketch per group and ratio."""
    rows = df.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.expr(f"({v[0]}) / greatest({v[1]}, 1)").alias("x")) for k, v in RATIOS.items()])).alias("r"))
    bucket = F.when(F.col("r.x") <= FLOOR, 0).otherwise(F.ceil(F.log(F.col("r.x") / FLOOR) / math.log(GROWTH))).cast("int")
    return rows.groupBy("lang", "source", F.col("r.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Low tail, centre and upper quartile of each sketch (relative error of about one hundredth)."""
    w = Window.partitionBy(*keys, "ratio")
    at = sketch.withColumn("rank", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(FLOOR * F.pow(F.lit(GROWTH), F.col("bucket") - 0.5))
    return at.groupBy(*keys, "ratio").agg(F.max("all").alias("n"), *[
        F.min(F.when(F.col("rank") >= F.ceil(F.lit(q) * F.col("all")), value)).alias(name)
        for name, q in (("low", TAIL), ("mid", CENTRE), ("high", QUARTER))])


def thresholds(df: DataFrame) -> DataFrame:
    """(lang, source, limits): lower and upper limit of each ratio."""
    sketch = written(sketched(df), "rule-sketch")
    per_lang = quantiles(sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    per_source = quantiles(sketch, ["lang", "source"])
    at = lambda c: scaled(F.col("ratio"), F.col(c))
    above = (at("high") - at("mid")) / NORMAL[QUARTER]
    spread = {"up": F.when(F.col("mid") > 0, (at("mid") - at("low")) / NORMAL[TAIL]).otherwise(above), "down": above}
    margin = lambda side: F.greatest(REACH * spread[side], noise)
    noise = F.element_at(F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v[3]))]), F.col("ratio"))
    shape = lambda d, p: d.select(*[c for c in ("lang", "source", "ratio") if c in d.columns], F.col("n").alias(f"{p}_n"), at("mid").alias(f"{p}_mid"),
                                  margin("up").alias(f"{p}_up"), margin("down").alias(f"{p}_down"))
    lang, own = shape(per_lang, "g"), shape(per_source, "s")
    both = own.alias("s").join(lang.alias("g"), F.col("s.lang").eqNullSafe(F.col("g.lang")) & (F.col("s.ratio") == F.col("g.ratio")))
    weight = F.col("s_n") / (F.col("s_n") + SMALL_GROUP)
    blend = lambda a, b: weight * F.col(a) + (1 - weight) * F.col(b)
    bound = lambda side: F.greatest(F.least(blend(f"s_{side}", f"g_{side}"), 2 * F.col(f"g_{side}")), F.col(f"g_{side}") / 2)
    centre = F.greatest(F.least(blend("s_mid", "g_mid"), F.col("g_mid") + F.col("g_up") / 2), F.col("g_mid") - F.col("g_down") / 2)
    limit = lambda t: unscaled(F.col("s.ratio"), t)
    rows = both.select("s.lang", "s.source", "s.ratio", limit(centre + bound("up")).alias("upper"), limit(centre - bound("down")).alias("lower"))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("ratio", F.struct("lower", "upper")))).alias("limits"))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc``, the counts, ``base_failed``, ``failed`` (names of the adaptive rules that speak against it) and ``kept``.

    The counts are written once, so texts are read once; the thresholds are a small written table whose size the join can see.
    """
    counted = written(measured(docs, keep), "rule-counts")
    limits = written(thresholds(counted.filter(~base_rule())), "rule-limits")
    rules = []
    for name, (count, size, side, _, events) in RATIOS.items():
        limit = F.element_at(F.col("limits"), F.lit(name))
        out = F.expr(count) > limit["upper"] * F.expr(size) + events
        if side == "both":
            out = out | (F.expr(count) < limit["lower"] * F.expr(size) - SHORT_EVENTS)
        rules.append(F.when(out, F.lit(name)))
    joined = counted.alias("c").join(limits.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select("doc", *COUNTS, base_rule().alias("base_failed"), F.array_compact(F.array(*rules)).alias("failed")) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, keep=["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), *BASE, "base_failed", "kept", "failed")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, columns unchanged."""
    return judged(docs).filter("kept").select("doc.*")
