"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the classes it forms.

A document is the set of its distinct word n-grams. Its tokens are put in one global order, rarest first, by a count sketch over all
documents. If two sets are similar, the larger overlap t that one of them needs means that their l-prefixes (the first n - t + l tokens)
share at least l tokens, for every l. Each document lengthens its prefix while that lowers its estimated cost (posting entries read plus
expected candidates verified); a pair must then share min(l, l') tokens that lie in both min(l, l')-prefixes before it is verified exactly.

Steps, each a Spark job over written tables:
 1. sketch: token counts in a bounded number of counters that follows the input, summed in tasks and then by counter range;
 2. prefixes: one row per document; equal sets become one class representative by a fingerprint of 128 bits. Tasks number the sets that they meet, so
    that prefixes need no other number and move once; of a set numbered by several tasks one number alone is listed;
 3. postings: prefix tokens, packed by hash range, meet in numpy. A token of at most ``SHORT_LIST`` representatives gives its pairs;
    a longer list only joins its members to the list's plainest member (the pivot), so no list is expanded into pairs of rows;
 4. pairs that share enough prefix tokens, and pivots with their members, form groups of candidates. A group of at most ``CHUNK`` sets is verified
    in one place, so each set moves once. In a larger one the members are compared with their pivots first; what is still apart is compared in chunks
    against chunks, inside tasks: members of a pivot's group unless their chunks are one class by then, other pairs only between chunks that
    hold one. Tasks emit links that span what they connected;
 5. classes: smallest doc_id reachable, by label propagation with pointer jumping.

Only narrow rows are shuffled for all documents; texts are read again just for documents that have a candidate. What a step has written or shuffled is
removed when the next ones need it no more.

Defined cases: null, empty and blank texts have no set and stay alone; a text shorter than n words is one token; repeated rows and equal
sets share a class; a row without doc_id gets its class's smallest doc_id, or null; empty input gives an empty result; further columns are
not read. Hash values have 64 bits per token and 128 per set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import scratch, shipped, written
from .text import WordHashes, column, mapped, read, shingle_set, words

RANGES = 64
LEAST_BITS, MOST_BITS, TOKENS_PER_COUNTER, BYTES_PER_TOKEN = 16, 24, 16, 6.5
VERIFY_COST = 60.0  # a verified candidate against one posting entry
MOST_SHARED = 96
SEEN = 500_000  # sets that a task remembers, so that copies are not listed again
CHANCE = 0.08  # how the share of common tokens of chance candidates falls off
SHORT_LIST = 24
CHUNK = 384
POSTINGS_PER_PART = 1_500_000


def needed(n: np.ndarray | int, percent: int):
    """The least overlap a set of n tokens has with any set at least ``percent`` hundredths similar to it."""
    return -(-n * percent // 100)


# 1. the sketch ---------------------------------------------------------------------------------------------------------------------------

def counts_packed(counts: np.ndarray) -> bytes:
    """32-bit counts by byte planes: nearly all of them fit the lowest one."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def counts_unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def counter_bits(docs: DataFrame) -> int:
    """So many counters that a few tokens share one, between 2 ** LEAST_BITS and 2 ** MOST_BITS of them (bounded memory; more tokens only blur the order)."""
    tokens = (docs.agg(F.sum(F.octet_length(column(docs, "text")).cast("long"))).first()[0] or 0) / BYTES_PER_TOKEN
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, tokens / TOKENS_PER_COUNTER)))))


def sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Counter per token hash range, over the sets of all documents."""
    hashes, counters = WordHashes(), 1 << bits
    step, shift = counters // RANGES, np.uint64(64 - bits)

    def run(batches):
        table = np.zeros(counters, np.uint32)
        for batch in batches:
            slots = [shingle_set(hashes.of(words(t.as_py())), size) >> shift for t in batch.column("text")]
            if slots:  # in place: a bincount would be four tables at once
                np.add.at(table, np.concatenate(slots).astype(np.int64), np.uint32(1))
        parts = [counts_packed(table[i * step:(i + 1) * step]) for i in range(RANGES)] if table.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += counts_unpacked(c.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "counts"])
    rows = mapped(docs.select(column(docs, "text")), run, "part int, counts binary").groupBy("part").applyInArrow(merged, "part int, counts binary").collect()
    out = np.zeros(counters, np.int64)
    for r in rows:
        out[r.part * step:(r.part + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return out


class Order:
    """Estimated further documents per token, and the global order that follows from the sketch."""

    def __init__(self, counters: np.ndarray):
        total = float(counters.sum())
        load = total / len(counters)
        self.shift = np.uint64(64 - (len(counters).bit_length() - 1))
        noise = 3 * math.sqrt(load) + 1
        excess = np.maximum(counters - load - noise, 0)
        # the second moment of the counters tells how many further documents a token has on average
        self.typical = min(1.0, max(0.0, float((counters.astype(np.float64) ** 2).sum()) - total ** 2 / len(counters) - total) / max(total, 1.0))
        self.rank = np.minimum(np.log2(1 + excess) * 8, 255).astype(np.uint8)  # coarse, so that noise does not reorder
        self.others = (np.exp2(np.arange(256) / 8) - 1).astype(np.float64)

    def prefix(self, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int, float]:
        """Tokens in global order as far as the chosen prefix goes, how many must be shared, and how plain the prefix is."""
        n = len(tokens)
        rank = self.rank[(tokens >> self.shift).astype(np.int64)]
        order = np.lexsort((tokens, rank))
        t = int(needed(n, percent))
        most = min(MOST_SHARED, t)
        base = n - t
        weight = np.cumsum(np.maximum(self.others[rank[order[:base + most]]], self.typical))
        shared = np.arange(1, most + 1)
        entries = weight[base:base + most]
        # chance candidates (a common passage) share a small part of a prefix; the more of it must be shared, the fewer are left
        cost = base + shared + entries + VERIFY_COST * entries * np.exp(-shared / (base + shared) / CHANCE)
        best = int(shared[np.argmin(cost)])
        return tokens[order[:base + best]], best, float(weight[base + best - 1] / (base + best))


# 2. prefixes and representatives ---------------------------------------------------------------------------------------------------------

def prefixes(docs: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """doc_id, row, n, print (of the set), and where a task meets a set for the first time also number, shared, plain and the prefix's tokens."""
    spark = docs.sparkSession
    shared, hashes = spark.sparkContext.broadcast(order), WordHashes()

    def run(batches):
        number, seen = TaskContext.get().partitionId() << 36, set()
        for batch in batches:
            out = []
            for t in batch.column("text"):
                s = shingle_set(hashes.of(words(t.as_py())), size)
                own = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if own is None or own in seen:
                    out.append((len(s), own, None, None, None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                number += 1
                tokens, most, plain = shared.value.prefix(s, percent)
                out.append((len(s), own, number, most, plain, tokens.tobytes()))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.float32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["doc_id", "row", "n", "print", "number", "shared", "plain", "tokens"])
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text"), row_print(docs).alias("row"))
    return mapped(rows, run, "doc_id long, row string, n long, print binary, number long, shared int, plain float, tokens binary")


def representatives(rows: DataFrame) -> DataFrame:
    """ref (the smallest number), print, doc_id and row (the smallest of both) of each distinct set, written."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    one = rows.filter("n > 0").groupBy("print").agg(first.alias("first"), F.min("number").alias("ref"))
    return written(one.select("ref", "print", "first.doc_id", "first.row"), "join-representatives")


# 3. postings -----------------------------------------------------------------------------------------------------------------------------

POSTING = np.dtype([("token", "<u8"), ("ref", "<i8"), ("plain", "<f4"), ("level", "u1"), ("shared", "u1")])


def entries_packed(e: np.ndarray) -> bytes:
    """By byte planes: numbers and weights of a document repeat, only tokens do not shrink."""
    return zlib.compress(np.ascontiguousarray(e.view(np.uint8).reshape(-1, POSTING.itemsize).T).tobytes(), 1)


def entries_unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(POSTING.itemsize, -1).T).view(POSTING).reshape(-1)


def levels(n: int, length: int, percent: int) -> np.ndarray:
    """The smallest l whose l-prefix holds each place of a prefix."""
    return np.maximum(np.arange(1, length + 1) - (n - int(needed(n, percent))), 1)


def postings(rows: DataFrame, parts: int, percent: int, again: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(part, entries): the prefix tokens of a batch of numbered sets, by hash range. Numbers ``again`` (:func:`packed_numbers`) are those of sets that
    are listed by another number: they would be paired with it."""
    own = rows.filter("number IS NOT NULL").withColumnRenamed("number", "ref")
    known = rows.sparkSession.sparkContext.broadcast(again)

    def run(batches):
        for batch in batches:
            found = []
            batch = batch.filter(pa.array(~is_packed(batch.column("ref").to_numpy(), known.value)))
            for ref, n, shared, plain, tokens in zip(*[batch.column(c).to_pylist() for c in ("ref", "n", "shared", "plain", "tokens")]):
                t = np.frombuffer(tokens, "<u8")
                e = np.empty(len(t), POSTING)
                e["token"], e["ref"], e["plain"], e["shared"] = t, ref, plain, shared
                e["level"] = levels(n, len(t), percent)
                found.append(e)
            if not found:
                continue
            every = np.concatenate(found)
            part = (every["token"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            groups = np.split(every[order], edges)
            yield pa.RecordBatch.from_arrays([pa.array([int(g["token"][0] % np.uint64(parts)) for g in groups], pa.int32()),
                                              pa.array([entries_packed(g) for g in groups], pa.binary())], ["part", "entries"])
    return mapped(own.select("ref", "n", "shared", "plain", "tokens"), run, "part int, entries binary")


def met(packed: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """Rows (a, b, matches, least, pivot): pairs with how many tokens they share here, or members ``b`` of the group of pivot ``a``."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([entries_unpacked(x.as_py()) for batch in batches for x in batch.column("entries")])
        e = e[np.lexsort((e["ref"], e["token"]))]
        e = e[np.append(True, (e["token"][1:] != e["token"][:-1]) | (e["ref"][1:] != e["ref"][:-1]))]
        first = np.flatnonzero(np.append(True, e["token"][1:] != e["token"][:-1]))
        size = np.diff(np.append(first, len(e)))
        a, b, least = [], [], []
        for k in np.unique(size[(size > 1) & (size <= short)]).tolist():
            at = first[size == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            x, y = e[at[:, i].ravel()], e[at[:, j].ravel()]
            low = np.minimum(x["shared"], y["shared"])
            good = (x["level"] <= low) & (y["level"] <= low)
            x, y, low = x[good], y[good], low[good]
            a.append(np.minimum(x["ref"], y["ref"]))
            b.append(np.maximum(x["ref"], y["ref"]))
            least.append(low)
        if a:
            a, b, least = np.concatenate(a), np.concatenate(b), np.concatenate(least)
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
            count = np.diff(np.append(new, len(a)))
            yield _met(a[new], b[new], count, least[new], False)
        members = set()
        for f, k in zip(first[size > short].tolist(), size[size > short].tolist()):
            own = e[f:f + k]
            pivot = int(own["ref"][np.lexsort((own["ref"], -own["plain"]))[0]])
            members.update((pivot, r) for r in own["ref"].tolist() if r != pivot)
        if members:
            m = np.array(sorted(members), np.int64)
            yield _met(m[:, 0], m[:, 1], np.ones(len(m), np.int64), np.ones(len(m), np.int64), True)
    return packed.groupBy("part").applyInArrow(run, "a long, b long, matches long, least long, pivot boolean")


def _met(a, b, matches, least, pivot):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(matches, pa.int64()), pa.array(least.astype(np.int64), pa.int64()),
                                       pa.array(np.full(len(a), pivot), pa.bool_())], ["a", "b", "matches", "least", "pivot"])


# 4. verification -------------------------------------------------------------------------------------------------------------------------

SLOTS = 1 << 20


def texts_of(docs: DataFrame, reps: DataFrame, placed: DataFrame) -> DataFrame:
    """(ref, root, large, print, text): the texts of the representatives in ``placed``; a text packs far better than its set of hashes. A ref may come
    more than once where rows repeat, and with another text where a doc_id repeats: readers compare the fingerprint."""
    wanted = written(reps.select("ref", "print", "doc_id").join(placed, "ref"), "join-wanted")
    texts = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))
    # a first look without a shuffle: at most SLOTS numbers are broadcast, however many ids are wanted
    slot = lambda d: F.pmod(F.xxhash64(d["doc_id"]), F.lit(SLOTS)).cast("int")
    texts = texts.withColumn("slot", slot(texts)).join(F.broadcast(wanted.select(slot(wanted).alias("slot")).distinct()), "slot", "left_semi").alias("d")
    return written(texts_at(texts, wanted), "join-texts")


def texts_at(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` (alias d) beside what is ``wanted`` of them. The latter grows with the documents: it is merged, and never broadcast while it is small."""
    return texts.join(wanted.alias("w").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.ref", "w.root", "w.large", "w.print", "d.text")


def own_sets(batch: pa.RecordBatch, hashes: WordHashes, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and whole set of each text that is the one its ref stands for."""
    for k, (text, own) in enumerate(zip(batch.column("text"), batch.column("print"))):
        s = shingle_set(hashes.of(words(text.as_py())), size)
        if xxhash.xxh3_128_digest(s.tobytes()) == own.as_py():
            yield k, s


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(ref, set) of rows of :func:`texts_of`, each ref once."""
    hashes = WordHashes()

    def run(batches):
        for batch in batches:
            found = list(own_sets(batch, hashes, size))
            yield pa.RecordBatch.from_arrays([batch.column("ref").take(pa.array([k for k, _ in found], pa.int64())), pa.array([s.tobytes() for _, s in found], pa.binary())], ["ref", "set"])
    return written(mapped(texts.select("ref", "print", "text"), run, "ref long, set binary").groupBy("ref").agg(F.first("set").alias("set")), "join-large")


def overlap(x: bytes, y: bytes) -> tuple[int, int, int]:
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, pivot) with ``linked``, by whole sets."""
    both = pairs.join(sets.select(F.col("ref").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("ref").alias("b"), F.col("set").alias("y")), "b")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                both, n, m = overlap(x.as_py(), y.as_py())
                linked.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("pivot"), pa.array(linked, pa.bool_())], ["a", "b", "pivot", "linked"])
    return mapped(both.select("a", "b", "pivot", "x", "y"), run, "a long, b long, pivot boolean, linked boolean")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Exact overlaps of all sets of x with all of y (of x with each other, if y is not given), by products of incidence blocks of a bounded width."""
    every = x + (y or [])
    rows = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, token, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    keep = count[token] > 1
    rows, token = rows[keep], np.unique(token[keep], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    out, width = np.zeros((len(x), len(y or x)), np.float32), 4096
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        f, t = np.searchsorted(token, [low, low + width])
        block = np.zeros((len(every), min(width, int(token[-1]) + 1 - low)), np.float32)
        block[rows[f:t], token[f:t] - low] = 1
        out += block[:len(x)] @ (block[len(x):] if y else block).T
    return out


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``links`` connects."""
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v
    out = []
    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


SETS_PER_TASK = 1000


def within_small(texts: DataFrame, members: int, size: int, percent: int) -> DataFrame:
    """Links (a, b) that span what is similar within each group (``root``) of a bounded number of sets; every text is moved once."""
    buckets, hashes = max(1, math.ceil(members / SETS_PER_TASK)), WordHashes()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            root, ref = batch.column("root").to_pylist(), batch.column("ref").to_pylist()
            for k, s in own_sets(batch, hashes, size):
                groups.setdefault(root[k], {})[ref[k]] = s
        out = []
        for found in groups.values():
            ref, x = np.array(list(found)), list(found.values())
            n = np.array([len(s) for s in x])
            i, j = np.triu_indices(len(x), 1)
            both = _overlaps(x)[i, j] if len(x) > 4 else np.array([len(np.intersect1d(x[a], x[b], assume_unique=True)) for a, b in zip(i, j)])
            linked = 100 * both >= percent * (n[i] + n[j] - both)
            out += spanning(np.stack([ref[i[linked]], ref[j[linked]]], axis=1))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])
    placed = texts.select("root", "ref", "print", "text", F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int").alias("bucket"))
    return placed.groupBy("bucket").applyInArrow(run, "a long, b long")


def verified(units: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what is similar between two chunks. ``units``: unit, x, y (chunks, x may be y); ``placed``: chunk, ref."""
    left, right = units.select("unit", F.lit(0).alias("side"), F.col("x").alias("chunk")), units.filter("x <> y").select("unit", F.lit(1).alias("side"), F.col("y").alias("chunk"))
    rows = left.unionByName(right).join(placed.select("chunk", "ref"), "chunk").select("unit", "side", "ref").join(sets, "ref")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for side, ref, s in zip(batch.column("side").to_pylist(), batch.column("ref").to_pylist(), batch.column("set")):
                sides[side][ref] = np.frombuffer(s.as_py(), "<u8")
        x, y = sides[0], sides[1] or sides[0]
        if not x:
            return
        both = _overlaps(list(x.values()), list(y.values()) if sides[1] else None)
        n, m = np.array([len(s) for s in x.values()])[:, None], np.array([len(s) for s in y.values()])[None, :]
        u, v = np.array(list(x)), np.array(list(y))
        i, j = np.nonzero((100 * both >= percent * (n + m - both)) & (u[:, None] != v[None, :]))
        out = np.array(spanning(np.stack([u[i], v[j]], axis=1)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], ["a", "b"])
    shipped(units.sparkSession)
    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def chunked(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """``rows`` (keys, ref, ...) with the name of a ``chunk``: at most about ``chunk`` refs of the same keys, by hash."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("full"))
    piece = F.pmod(F.xxhash64("ref"), F.ceil(F.col("full") / chunk))
    return rows.join(sizes, keys).withColumn("chunk", F.concat_ws(":", *keys, piece))


def within_groups(members: DataFrame, known: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between members of the same pivot's group. ``members``: pivot, ref; ``known``: ref, root (classes that are found already);
    ``roots``: ref, root (groups of candidates).

    A ref may lie in the groups of many pivots, but it is dealt into one chunk only: refs of a large class among themselves, others by their smallest
    pivot, several small groups together. Two chunks meet once if any pivot has members in both, unless both are one class already.
    """
    groups = members.unionByName(members.select("pivot", F.col("pivot").alias("ref"))).distinct()
    homes = groups.groupBy("ref").agg(F.min("pivot").alias("home")).join(roots.select("ref", "root"), "ref").join(known.select("ref", F.col("root").alias("own")), "ref", "left")
    count = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    homes = homes.join(count(homes.filter("own IS NOT NULL"), "own", "n"), "own", "left").withColumn("class", F.when(F.col("n") >= chunk / 2, F.col("own")))
    homes = homes.join(count(homes.filter("class IS NULL"), "home", "n_home"), "home", "left")
    key = F.when(F.col("class").isNotNull(), F.concat(F.lit("class "), "class")).when(F.col("n_home") > chunk, F.concat(F.lit("pivot "), "home")).otherwise(F.concat(F.lit("rest "), "root"))
    homes = written(homes.select("ref", "home", "class", key.alias("key")), "join-homes")
    piece = F.pmod(F.xxhash64(F.when(F.startswith("key", F.lit("rest ")), F.col("home")).otherwise(F.col("ref"))), F.ceil(F.col("full") / chunk))
    placed = written(homes.join(count(homes, "key", "full"), "key").select("ref", "class", F.concat_ws(":", "key", piece).alias("chunk")), "join-bands")
    there = groups.join(placed, "ref").select("pivot", "chunk", "class").distinct()
    x, y = there.alias("x"), there.alias("y")
    meet = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.chunk") <= F.col("y.chunk")) & ~F.coalesce(F.col("x.class") == F.col("y.class"), F.lit(False)))
    units = written(meet.select(F.col("x.chunk").alias("x"), F.col("y.chunk").alias("y")).distinct().withColumn("unit", F.monotonically_increasing_id()), "join-units")
    return verified(units, placed, sets, percent)


def between_chunks(pairs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) for candidate ``pairs`` (a, b) of large groups: their refs are dealt into chunks of a group, and two chunks meet once if any
    pair lies between them, so a set moves once per partner chunk and not once per pair."""
    refs = pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct().join(roots, "ref").select("ref", "root")
    placed = written(chunked(refs, ["root"], chunk), "join-chunks")
    at = lambda c: placed.select(F.col("ref").alias(c), F.col("chunk").alias(f"{c}_chunk"))
    both = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b").select(F.least("a_chunk", "b_chunk").alias("x"), F.greatest("a_chunk", "b_chunk").alias("y")).distinct()
    return verified(written(both.withColumn("unit", F.monotonically_increasing_id()), "join-units"), placed, sets, percent)


def links(docs: DataFrame, rows: DataFrame, reps: DataFrame, size: int, percent: int, short: int = SHORT_LIST, chunk: int = CHUNK) -> DataFrame:
    """Verified links (a, b) between representatives; they connect every pair of similar sets, directly or through others."""
    return confirmed(docs, reps, asked(rows, reps, percent, short), size, percent, chunk)


def asked(rows: DataFrame, reps: DataFrame, percent: int, short: int = SHORT_LIST) -> DataFrame:
    """Candidates (a, b, pivot): pairs that share enough prefix tokens, and pivots with the members of their long lists."""
    with scratch(rows.sparkSession) as keep:
        return keep(_asked(rows, reps, percent, short), "join-asked")


def _asked(rows: DataFrame, reps: DataFrame, percent: int, short: int) -> DataFrame:
    again = written(again_numbered(rows, reps), "join-again")
    bytes_of = lambda df: df.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0
    entries = (bytes_of(rows) - (again.agg(F.sum("bytes")).first()[0] or 0)) / 8
    found = written(met(postings(rows, max(8, math.ceil(entries / POSTINGS_PER_PART)), percent, packed_numbers(again)), short), "join-met")
    pairs = found.filter("NOT pivot").groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.min("least").alias("least")).filter("matches >= least")
    groups = found.filter("pivot").select("a", "b").distinct()
    return pairs.select("a", "b", F.lit(False).alias("pivot")).unionByName(groups.select("a", "b", F.lit(True).alias("pivot")))


def again_numbered(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(number, bytes of its tokens) of sets that several tasks have numbered, but for their representative's number."""
    own = rows.filter("number IS NOT NULL").select("print", "number", F.octet_length("tokens").cast("long").alias("bytes"))
    return own.join(reps.select("print", "ref"), "print").filter("number <> ref").select("number", "bytes")


def packed_numbers(again: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 numbers each, and their bits: tasks count upwards, so a numbered set costs at most a quarter of a byte."""
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(number % 64 AS INT))"))
    found = again.groupBy(F.shiftright("number", 6).alias("word")).agg(bits.alias("bits")).toArrow()
    word, bits = (found.column(c).to_numpy().astype(np.int64) for c in ("word", "bits"))
    order = np.argsort(word)
    return word[order], bits[order]


def is_packed(number: np.ndarray, packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    word, bits = packed
    if not len(word):
        return np.zeros(len(number), bool)
    at = np.minimum(np.searchsorted(word, number >> 6), len(word) - 1)
    return (word[at] == number >> 6) & (bits[at] >> (number & 63) & 1 == 1)


def confirmed(docs: DataFrame, reps: DataFrame, asked: DataFrame, size: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that span what is similar, by whole sets, among candidates ``asked`` (a, b, pivot): single pairs, and with ``pivot`` the members b of
    a's group, of which any two may be similar. Texts and sets are removed again."""
    with scratch(docs.sparkSession) as keep:
        return keep(_confirmed(docs, reps, asked, size, percent, chunk), "join-links")


def _confirmed(docs: DataFrame, reps: DataFrame, asked: DataFrame, size: int, percent: int, chunk: int) -> DataFrame:
    # candidates form groups; each is verified in one place while it is small, else pair by pair and by its pivots
    root = classes(asked)
    placed = written(root.join(root.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select("ref", "root", (F.col("n") > chunk).alias("large")), "join-placed")
    texts = texts_of(docs, reps, placed)
    inside = within_small(texts.filter("NOT large"), placed.filter("NOT large").count(), size, percent)
    large = placed.filter("large").select(F.col("ref").alias("a"))
    if not large.isEmpty():
        whole = sets_of(texts.filter("large"), size)
        hard = written(asked.join(large, "a", "left_semi"), "join-hard")
        # each member is compared with one pivot first; what else its groups may hold meets by chunks
        stars = hard.filter("pivot")
        checked = written(compared(stars.groupBy("b").agg(F.min("a").alias("a"), F.lit(True).alias("pivot")), whole, percent), "join-checked")
        near = checked.filter("linked").select("a", "b")
        # what the pivots have connected already needs no comparing
        known = classes(near)
        at = lambda c: known.select(F.col("ref").alias(c), F.col("root").alias(f"{c}_root"))
        members = stars.select(F.col("a").alias("pivot"), F.col("b").alias("ref"))
        open_pairs = hard.filter("NOT pivot").join(at("a"), "a", "left").join(at("b"), "b", "left").filter("a_root IS NULL OR b_root IS NULL OR a_root <> b_root")
        inside = inside.unionByName(near).unionByName(within_groups(members, known, placed, whole, percent, chunk)) \
            .unionByName(between_chunks(open_pairs.select("a", "b"), placed, whole, percent, chunk))
    return inside.distinct()


# 5. classes ------------------------------------------------------------------------------------------------------------------------------

def classes(edges: DataFrame) -> DataFrame:
    """(ref, root): the smallest ref reachable, written.

    Each ref is first tied to its smallest neighbour below it alone, and that one to the other neighbours below, which connects the same refs. Most
    refs are below nobody then (the members of a group that have met its pivots): they wait, and only the others go through rounds.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_classes(edges), "join-roots")


def _classes(edges: DataFrame) -> DataFrame:
    ordered = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    first = F.min("low").over(Window.partitionBy("high"))
    tied = written(ordered.withColumn("first", first), "join-tied")
    lows = written(tied.select(F.col("low").alias("ref")).distinct(), "join-lows")
    ties = tied.filter("low = first AND low < high").select("first", "high")
    leaves = written(ties.join(lows, F.col("high") == F.col("ref"), "left_anti"), "join-leaves")
    inner = ties.join(lows, F.col("high") == F.col("ref"), "left_semi").select(F.col("first").alias("a"), F.col("high").alias("b"))
    across = tied.filter("low <> first").select(F.col("first").alias("a"), F.col("low").alias("b"))
    root = _rounds(inner.unionByName(across))
    held = written(lows.join(root, "ref", "left").select("ref", F.coalesce("root", "ref").alias("root")), "join-held")
    hanging = leaves.join(held.select(F.col("ref").alias("first"), "root"), "first").select(F.col("high").alias("ref"), "root")
    return held.unionByName(hanging)


def _rounds(edges: DataFrame) -> DataFrame:
    """(ref, root): the smallest ref reachable. Each round takes the neighbours' smallest label, then the label of the label."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("ref"), F.least("a", "m").alias("root")), "join-label")
    while True:
        lower = both.join(label.select(F.col("ref").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        new = label.join(lower.select(F.col("a").alias("ref"), "r"), "ref").select("ref", F.least("root", "r").alias("next"), F.col("root").alias("old"))
        new = written(new, "join-label")
        jumped = new.join(new.select(F.col("ref").alias("next"), F.col("next").alias("far")), "next", "left")
        label = written(jumped.select("ref", F.least("next", F.coalesce("far", "next")).alias("root"), "old"), "join-label")
        if label.filter("root <> old").isEmpty():
            return label.select("ref", "root")
        label = label.select("ref", "root")


def row_print(docs: DataFrame):
    """Tells rows apart by their atomic columns (96 bits of hash)."""
    atomic = [column(docs, f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return F.concat_ws(":", F.xxhash64(*atomic).cast("string"), F.hash(*atomic).cast("string"))


def joined(docs: DataFrame, size: int, percent: int, short: int = SHORT_LIST, chunk: int = CHUNK) -> DataFrame:
    """doc_id, row, n_shingles, component_id and class (null without words) of every row of ``docs``, written; what leads there is removed, each
    step's tables and shuffles as soon as the next one has what it needs."""
    with scratch(docs.sparkSession) as keep:
        return keep(_joined(docs, size, percent, short, chunk), "join-joined")


def _joined(docs: DataFrame, size: int, percent: int, short: int, chunk: int) -> DataFrame:
    with scratch(docs.sparkSession) as keep:
        order = Order(sketch(docs, size, counter_bits(docs)))
        full = written(prefixes(docs, order, size, percent), "join-prefixes")
        # the tokens go before texts are read again
        rows, reps = keep(full.select("doc_id", "row", "n", "print"), "join-rows"), keep(representatives(full), "join-representatives")
        candidates = keep(asked(full, reps, percent, short), "join-candidates")
    root = classes(confirmed(docs, reps, candidates, size, percent, chunk))
    at = reps.select("ref", "print", "doc_id").join(root, "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    least = at.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classed = written(at.join(least, "root").select("print", "component_id", F.col("root").alias("class")), "join-classes")
    return rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "print").join(classed, "print", "left") \
        .select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def checking_sql(size: int, percent: int, more: str = "") -> str:
    """The same classes by comparing every pair that shares a shingle: for small tables."""
    return rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {size} + 2), lambda i: array_to_string(list_slice(ws, i, i + {size} - 1), ' ')) END) AS shingle FROM t),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE 100 * common >= {percent} * (a.n + b.n - common)),
r AS (SELECT id, id AS root FROM t UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
m AS (SELECT r.id, min(t.doc_id) AS component_id FROM r JOIN t ON t.id = r.root GROUP BY r.id)
SELECT t.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id{more} FROM t JOIN m USING (id) LEFT JOIN c USING (id)
"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(read(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85).select("doc_id", "n_shingles", "component_id")


DROPPED_BITS = 27  # of the first look: 16 MB


def hit(rows: DataFrame, bits: int):
    """A condition that holds for every row whose ``slot`` (a hash) is one of those of ``rows``, and for few others while these are fewer than the
    2 ** bits places: a bitmap of bounded size, put together from 64-bit words."""
    place = F.col("slot").bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.select(place.alias("place")).groupBy((F.col("place") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("set"))
    found, table = words.toArrow(), np.zeros(1 << bits - 6, np.uint64)
    table[np.asarray(found.column("word"), np.int64)] = np.asarray(found.column("set"), np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
    held: list[np.ndarray] = []

    @F.pandas_udf("boolean")
    def is_hit(slot: pd.Series) -> pd.Series:
        if not held:
            held.append(np.frombuffer(zlib.decompress(shared.value), np.uint64))
        at = slot.to_numpy(np.int64) & np.int64((1 << bits) - 1)
        return pd.Series((held[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
    return is_hit(F.col("slot"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, short: int = SHORT_LIST, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id (null last), then the smallest row print; of equal rows one.

    Rows without words are in no class and all stay.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        found = written(joined(docs, size, percent, short, chunk).filter("class IS NOT NULL").groupBy("class", "row", "doc_id").agg(F.count(F.lit(1)).alias("times")), "join-rows")
        first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first"))
        marked = found.join(first, "class").select("row", "times", (F.col("row") == F.col("first.row")).alias("keep"))
        # rows that go (keep is false) or stay once of several equal ones
        marked = keep(marked.filter("NOT keep OR times > 1").select("row", "keep", F.xxhash64("row").alias("slot")), "join-marked")
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("doc"), row_print(docs).alias("row"))
    if marked.isEmpty():
        return docs
    # only documents that a bitmap of the marked rows lets through are moved; all others stay where they are
    looked = rows.withColumn("slot", F.xxhash64("row"))
    seen = hit(marked, DROPPED_BITS)
    known = looked.filter(seen).drop("slot").join(marked.drop("slot"), "row", "left").filter("keep IS NULL OR keep")
    # rows that are not marked after all stay as often as they are
    known = known.withColumn("own", F.when(F.col("keep").isNull(), F.monotonically_increasing_id())).dropDuplicates(["row", "own"])
    return looked.filter(~seen).select("doc.*").unionByName(known.select("doc.*"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, by five words and a similarity of 0.8."""
    return one_of_each(docs)
