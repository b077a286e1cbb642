"""Phrases of up to four words that keep together, per language, by top-order marginalisation.

Only the longest windows are counted: each word of a piece with the words that follow it in lead columns, padded at the piece's end. The counts
of all shorter phrases are marginal sums of these, which one ROLLUP over (lang, w1, w2, w3, w4) gives; n-grams of other orders are never listed.

The windows are most of the work, as nearly every one is new. So they are not moved as rows:
 1. frequent words: those with at least one in ``HOT`` of all words, of which there are at most ``HOT``; they only steer the placing;
 2. windows: tasks number the words of a bounded chunk, sum equal windows and send them packed, with the words that they use, to the hash range
    of their first two words. Windows whose first two (three) words are all frequent go by their first three (four), so a very common pair is
    spread over the ranges;
 3. in a range, the sums of every prefix at least as long as the placed one are whole. A window is cut to its longest prefix that can still
    reach ``least``; its count stays with what is left of it, so no sum of a shorter prefix changes. Words that cannot reach ``least`` are
    counted as one nameless word;
 4. ROLLUP sums what remains: the count of every phrase that occurs ``least`` times or more, and of all words, is exact;
 5. cuts, drops and ranks are joins on that short list.

Rows: a null or empty text has no words, a null lang is ``und``, rows that repeat count as often as they occur; an empty table, or one in which no
phrase is frequent, gives no rows; further columns are not read. A task holds a chunk of words, or one piece where a single piece without
any mark is longer.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import shipped, written
from .text import column, mapped, mixed, read, slices

LEAST, KEPT_SHARE, TOP = 30, 80, 2000
ORDER = 4
HOT = 4096
CHUNK_WORDS = 1_000_000
ENTRIES_PER_PART = 1_000_000
HELD_WORDS = 500_000

# lower-cases A-Z; every mark that ends a piece becomes a line break
_PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
MARK = b"\xff"  # no byte of UTF-8
_FACTORS = np.random.default_rng(12).integers(1, 2**63, ORDER + 1, dtype=np.uint64) | np.uint64(1)
COLUMNS = [f"w{k}" for k in range(1, ORDER + 1)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(column(docs, "lang").cast("string"), F.lit("und")).alias("lang"), column(docs, "text").cast("string").alias("text"))


# 1. frequent words -----------------------------------------------------------------------------------------------------------------------

def frequent_words(texts: DataFrame, share: int = HOT) -> tuple[set[bytes], int]:
    """At most ``share`` words, among them all that are at least 2 / share of all words; and how many words there are."""
    def run(batches):
        held, total = Counter(), 0

        def rows():
            found = [(w, n) for w, n in held.items() if n * share >= total] + [(None, total)]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column("text"):
                for piece in slices((text.as_py() or "").encode().translate(_PIECES)):
                    found = piece.split()
                    held.update(found)
                    total += len(found)
                if len(held) > HELD_WORDS:
                    yield rows()
                    held, total = Counter(), 0
        if total:
            yield rows()
    found = written(mapped(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "phrase-words")
    total = found.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    return {bytes(r.word) for r in found.filter((F.col("n") * share >= total) & F.col("word").isNotNull()).select("word").collect()}, total


# 2. windows ------------------------------------------------------------------------------------------------------------------------------

class Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        value = self[word] = len(self)
        return value

    def of(self, found: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def lead(tokens: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """The longest window at each word: the word and its lead columns, 0 from the end of its piece (a 0 in ``tokens``) on."""
    out = [tokens]
    for k in range(1, order):
        out.append(np.where(out[-1] == 0, 0, np.append(tokens[k:], np.zeros(min(k, len(tokens)), np.int64))))
    return [c[tokens != 0] for c in out]


def run_starts(columns) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(columns[0]) else np.empty(0, np.int64)


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and their sums."""
    lang, a, b, c, d = columns
    order = np.lexsort((c << 32 | d, a << 32 | b, lang))
    columns = [x[order] for x in columns]
    first = run_starts(columns)
    return [x[first] for x in columns], np.add.reduceat(n[order], first) if len(first) else n[:0]


def depth(columns: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """How many leading words place a window: two, or one more than its leading frequent words."""
    two = hot[columns[1]] & hot[columns[2]]
    return 2 + two.astype(np.int64) + (two & hot[columns[3]])


def places(columns: list[np.ndarray], hashes: np.ndarray, langs: np.ndarray, by) -> np.ndarray:
    """Hash of the leading ``by`` words of each window."""
    out = langs[columns[0]] * _FACTORS[0]
    for k in range(1, ORDER + 1):
        out += np.where(k <= by, hashes[columns[k]] * _FACTORS[k], np.uint64(0))
    return mixed(out)


def counted_once(columns: list[np.ndarray], order_by: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs, brought together by a hash; should two share one, a row may come twice, which sums allow."""
    order = np.argsort(order_by)
    columns = [c[order] for c in columns]
    first = run_starts(columns)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def pack(columns: list[np.ndarray], n: np.ndarray, words: list[bytes], langs: list[str]) -> bytes:
    used, inside = np.unique(np.concatenate(columns[1:]), return_inverse=True)
    own, lang = np.unique(columns[0], return_inverse=True)
    narrow = lambda x: np.asarray(x, np.uint16 if len(used) < 65_536 and len(own) < 65_536 else np.uint32).tobytes()
    lists = [narrow(x) for x in (lang, *np.split(inside, ORDER))]
    return zstandard.compress(pickle.dumps((b"\n".join([words[i] for i in used.tolist()]), [langs[i] for i in own.tolist()], lists, n.astype(np.uint32).tobytes())), 1)


def unpack(data: bytes, ids: Ids, langs: Ids) -> tuple[list[np.ndarray], np.ndarray]:
    words, own, lists, n = pickle.loads(zstandard.decompress(data))
    n = np.frombuffer(n, np.uint32).astype(np.int64)
    kind = np.uint16 if len(lists[0]) == 2 * len(n) else np.uint32
    back = [langs.of(own), *[ids.of(words.split(b"\n"))] * ORDER]
    return [b[np.frombuffer(x, kind)] for b, x in zip(back, lists)], n


def windows(texts: DataFrame, hot: set[bytes], parts: int) -> DataFrame:
    """(part, entries): the summed windows of a chunk of words, by the range that they are placed in."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def packed(held: list[tuple[int, np.ndarray]], ids: Ids, langs: Ids):
        tokens = np.concatenate([t for _, t in held])
        lang = np.repeat([k for k, _ in held], [len(t) for _, t in held])[tokens != 0]
        words, names = list(ids), list(langs)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        own = np.fromiter((xxhash.xxh3_64_intdigest(x, seed=1) for x in names), np.uint64, len(names))
        is_hot = np.fromiter((w in shared.value for w in words), bool, len(words))
        columns = [lang, *lead(tokens)]
        columns, n = counted_once(columns, places(columns, hashes, own, ORDER))
        part = (places(columns, hashes, own, depth(columns, is_hot)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, columns, n = part[order], [c[order] for c in columns], n[order]
        first = run_starts([part])
        ends = np.append(first[1:], len(part))
        blobs = [pack([c[f:e] for c in columns], n[f:e], words, names) for f, e in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])

    def run(batches):
        held, ids, langs, total = [], Ids({MARK: 0}), Ids(), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for piece in slices((text.as_py() or "").encode().translate(_PIECES), b"\n"):
                    tokens = ids.of(piece.replace(b"\n", b" \xff ").split())
                    if tokens.any():
                        held.append((langs[lang], np.append(tokens, 0)))
                        total += len(tokens)
                    if total >= CHUNK_WORDS:
                        yield packed(held, ids, langs)
                        held, ids, langs, total = [], Ids({MARK: 0}), Ids(), 0
        if held:
            yield packed(held, ids, langs)
    return mapped(texts, run, "part int, entries binary")


# 3. cut windows --------------------------------------------------------------------------------------------------------------------------

def cut(columns: list[np.ndarray], n: np.ndarray, by: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted windows cut to the longest prefix that may still reach ``least``, summed again. Prefixes shorter than ``by`` words are not whole here."""
    length = np.where(n >= least, ORDER, ORDER - 1)
    for k in range(ORDER - 1, 1, -1):
        first = run_starts(columns[:k + 1])
        whole = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n))))
        length = np.where((length == k) & (by <= k) & (whole < least), k - 1, length)
    return summed([columns[0], *[np.where(k <= length, c, 0) for k, c in enumerate(columns[1:], 1)]], n)


def remaining(packed: DataFrame, hot: set[bytes], least: int) -> DataFrame:
    """(lang, w1, ..., n): the windows of all ranges, cut; '' stands for a padded word."""
    shared = packed.sparkSession.sparkContext.broadcast(hot)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, langs = Ids({MARK: 0}), Ids()
        found = [unpack(x.as_py(), ids, langs) for batch in batches for x in batch.column("entries")]
        columns, n = summed([np.concatenate(c) for c in zip(*[f[0] for f in found])], np.concatenate([f[1] for f in found]))
        words = list(ids)
        is_hot = np.fromiter((w in shared.value for w in words), bool, len(words))
        columns, n = cut(columns, n, depth(columns, is_hot), least)
        named, lang = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string()), pa.array(list(langs), pa.string())
        for k in range(0, len(n), 100_000):
            rows = [lang.take(pa.array(columns[0][k:k + 100_000])), *[named.take(pa.array(c[k:k + 100_000])) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(n[k:k + 100_000], pa.int64())], ["lang", *COLUMNS, "n"])
    schema = "lang string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", n long"
    return packed.groupBy("part").applyInArrow(run, schema)


# 4. marginal sums ------------------------------------------------------------------------------------------------------------------------

def phrase_counts(docs: DataFrame, least: int = LEAST, share: int = HOT, per_part: int = ENTRIES_PER_PART) -> DataFrame:
    """(lang, words, f): every phrase of one to four words that occurs ``least`` times or more, and with no words the number of all words of a lang."""
    texts = _texts(docs)
    hot, total = frequent_words(texts, share)
    shipped(docs.sparkSession)
    top = written(remaining(windows(texts, hot, max(1, math.ceil(total / per_part))), hot, least), "phrase-windows")
    longer = top.filter("w2 <> ''")
    # single words that are rare and begin no frequent phrase matter for the number of words only
    alone = top.filter("w2 = ''").groupBy("lang", "w1").agg(F.sum("n").alias("n")).join(longer.select("lang", "w1", F.lit(True).alias("begins")).distinct(), ["lang", "w1"], "left")
    alone = alone.select("lang", F.when((F.col("n") >= least) | F.col("begins"), F.col("w1")).otherwise("").alias("w1"), *[F.lit("").alias(c) for c in COLUMNS[1:]], "n")
    sums = longer.unionByName(alone).rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    # of each level those rows that end in a word; the level of the lang alone is the number of its words
    order = F.lit(ORDER) - F.length(F.regexp_replace(F.bin("left_out"), "0", "")).cast("int")
    sums = sums.withColumn("order", order).filter("order >= 0").withColumn("words", F.slice(F.array(*COLUMNS), 1, F.col("order")))
    return written(sums.filter(f"order = 0 OR (f >= {least} AND NOT array_contains(words, ''))").select("lang", "words", "f"), "phrase-counts")


# 5. scores -------------------------------------------------------------------------------------------------------------------------------

def collocations(docs: DataFrame, least: int = LEAST, kept_share: int = KEPT_SHARE, top: int = TOP, share: int = HOT, per_part: int = ENTRIES_PER_PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k (words before the lowest-scoring cut)."""
    counts = phrase_counts(docs, least, share, per_part)
    named = counts.filter("size(words) > 0").withColumn("phrase", F.concat_ws(" ", "words"))
    phrases = named.filter("size(words) > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.expr("slice(words, 1, k)")).alias("first"), F.concat_ws(" ", F.expr("slice(words, k + 1, size(words) - k)")).alias("rest"))
    part = lambda name, f: named.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(CAST(2000000 * CAST(a AS DECIMAL(28, 0)) AS DECIMAL(38, 0)) div CAST(l + r AS DECIMAL(20, 0)) AS BIGINT)")
    scored = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> concat_ws(' ', slice(words, i, s)))))")
    around = phrases.filter("size(words) > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(28, 0)) < {kept_share} * CAST(a AS DECIMAL(28, 0))")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).filter(F.col("rank") <= top)
    total = counts.filter("size(words) = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "cut.k")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang")).drop("k")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
x AS (SELECT lang, w1, lead(w1) OVER v AS w2, lead(w1, 2) OVER v AS w3, lead(w1, 3) OVER v AS w4 FROM o WINDOW v AS (PARTITION BY piece ORDER BY i)),
s AS (SELECT lang, [w1] AS words, count(*) AS f FROM x GROUP BY lang, w1 UNION ALL SELECT lang, [w1, w2], count(*) FROM x WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
      UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM x WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
      UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM x WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4),
f AS (SELECT lang, words, array_to_string(words, ' ') AS phrase, len(words) AS size, f::HUGEINT AS f FROM s WHERE f >= 30),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
h AS (SELECT *, unnest(range(1, size)) AS k FROM f),
g AS (SELECT lang, phrase, f, k, array_to_string(list_slice(words, 1, k), ' ') AS first, array_to_string(list_slice(words, k + 1, size), ' ') AS rest FROM h),
c AS (SELECT g.lang, g.phrase, g.f AS a, k, l.f AS l, r.f AS r, (2000000 * g.f) // (l.f + r.f) AS score
      FROM g JOIN f l ON l.lang = g.lang AND l.phrase = g.first JOIN f r ON r.lang = g.lang AND r.phrase = g.rest),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(list_slice(words, j, j + m - 1), ' ') AS phrase, max(f) AS longer
      FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS j) WHERE size > m AND j + m - 1 <= size GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM d JOIN t USING (lang) QUALIFY rank <= 2000
"""
