"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (A-Z lower-cased). Windows of ``SHORTEST`` words, hashed in the manner of Karp and Rabin,
are the seeds: documents are joined with the items that share one. For each such pair the longest common run of unmarked words is found from
the window hashes, marked as a tile in both, and so on until no run of ``SHORTEST`` words is left; tiles never overlap, and their order does
not matter, so passages whose sentences were moved are caught. A document is contaminated by an item if tiles cover ``COVERAGE`` of it.

Items are gone through in blocks of a bounded number of words. Where there is more than one, each block's matches are written before the next
block is read and its broadcast is released, so neither the driver nor a task holds more than one block; texts are read once per block.
Documents are never grouped by what they share, so a passage that a third of them have is no hot key.

Defined cases: null or empty texts and documents or items of fewer than ``SHORTEST`` words match nothing; items with equal words are both
reported; repeated rows are treated one by one; empty documents or an empty benchmark give an empty result; input columns travel in
the struct ``doc``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .text import WordHashes, column, mapped, read, windows, words

SHORTEST, COVERAGE = 5, 0.8
BLOCK_WORDS = 1_000_000
MATCH = "array<struct<item_id:bigint,covered:int,item_words:int,tiles:array<struct<item_at:int,doc_at:int,words:int>>>>"


def runs(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (start in item, start in document, words) of window matches (i, j), longest first, then by place."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + size - 1
    best = np.lexsort((j[first], i[first], -length))
    return i[first][best], j[first][best], length[best]


def tiles(item: np.ndarray, doc: np.ndarray, size: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word-hash sequences: (start in item, start in document, words), longest tiles first."""
    wi, wj = windows(item, size), windows(doc, size)
    order = np.argsort(wi, kind="stable")
    low, high = np.searchsorted(wi[order], wj, "left"), np.searchsorted(wi[order], wj, "right")
    n = high - low
    j = np.repeat(np.arange(len(wj)), n)
    i = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    used_i, used_j, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while len(i):
        a, b, length = runs(i, j, size)
        for x, y, k in zip(a.tolist(), b.tolist(), length.tolist()):
            if k < length[0]:
                break
            if not used_i[x:x + k].any() and not used_j[y:y + k].any():
                used_i[x:x + k] = True
                used_j[y:y + k] = True
                out.append((x, y, k))
        blocked_i, blocked_j = np.convolve(used_i, np.ones(size, int))[size - 1:len(item)] > 0, np.convolve(used_j, np.ones(size, int))[size - 1:len(doc)] > 0
        free = ~blocked_i[i] & ~blocked_j[j]
        i, j = i[free], j[free]
    return out


class Items:
    """A block of the benchmark: word hashes of each item, and the sorted seeds with the items that hold them."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes = WordHashes()
        self.items = [(item_id, hashes.of(words(text))) for item_id, text in rows]
        seeds = [windows(h, SHORTEST) for _, h in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        every = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)  # a first look by twenty bits of the seed
        self.maybe[every >> np.uint64(44)] = True

    def sharing(self, doc: np.ndarray) -> list[int]:
        w = windows(doc, SHORTEST)
        w = np.unique(w[self.maybe[w >> np.uint64(44)]])
        low, high = np.searchsorted(self.seeds, w, "left"), np.searchsorted(self.seeds, w, "right")
        return sorted({int(k) for a, b in zip(low, high) if a < b for k in self.owner[a:b]})

    def matches(self, doc: np.ndarray, coverage: float) -> list[dict]:
        out = []
        for k in self.sharing(doc):
            item_id, item = self.items[k]
            found = tiles(item, doc)
            covered = sum(t[2] for t in found)
            if covered >= coverage * len(item):
                out.append({"item_id": item_id, "covered": covered, "item_words": len(item),
                            "tiles": [dict(zip(("item_at", "doc_at", "words"), t)) for t in sorted(found)]})
        return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> tuple[int, Iterator[Items]]:
    """How many blocks of about ``limit`` words the benchmark has, and the blocks, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, math.ceil(total / limit))
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return parts, (Items([tuple(r) for r in rows.filter(part_of == part).orderBy("item_id", "text").collect()]) for part in range(parts))


def matched(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, coverage: float = COVERAGE, limit: int = BLOCK_WORDS) -> DataFrame:
    """``doc`` (columns ``keep``) and ``matches`` (with one block of items: of every document; with more, a row for each block that matches)."""
    keep = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[column(docs, c) for c in docs.columns if c in keep]).alias("doc"), F.col("text"))
    kind = packed.schema["doc"].dataType.simpleString()
    entry = pa.struct([("item_id", pa.int64()), ("covered", pa.int32()), ("item_words", pa.int32()),
                       ("tiles", pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])))])
    parts, every = blocks(benchmark, limit)
    out = None
    for items in every:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by ``limit`` words
        hashes = WordHashes()

        def run(batches, shared=shared, hashes=hashes):
            for batch in batches:
                found = [shared.value.matches(hashes.of(words(t.as_py())), coverage) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.list_(entry))], ["doc", "matches"])
        part = mapped(packed, run, f"doc {kind}, matches {MATCH}")
        if parts > 1:
            part = written(part.filter(F.size("matches") > 0), "tiling-matches")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item."""
    found = matched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    rows = found.select("doc.doc_id", F.explode("matches").alias("m"))
    return rows.select("doc_id", "m.item_id", "m.covered", "m.item_words", F.size("m.tiles").alias("n_tiles"), (F.col("m.covered") / F.col("m.item_words")).alias("coverage"))


def stage(spark, docs: DataFrame, sf_dir: str, limit: int = BLOCK_WORDS) -> DataFrame:
    """Documents that no benchmark item contaminates, columns unchanged. One block filters the documents as they are read; more of them write
    the digests of the texts they match, which are joined at the end."""
    parts, every = blocks(read(spark, sf_dir, "benchmark"), limit)
    digest = lambda d: F.struct(F.md5(column(d, "text").cast("string")), F.xxhash64(column(d, "text")))
    hit = None
    for items in every:
        shared = spark.sparkContext.broadcast(items)
        hashes = WordHashes()

        def run(batches, shared=shared, hashes=hashes, wanted=parts > 1):
            for batch in batches:
                found = [bool(shared.value.matches(hashes.of(words(t.as_py())), COVERAGE)) == wanted for t in batch.column("text")]
                yield batch.filter(pa.array(found, pa.bool_()))
        if parts == 1:
            return mapped(docs, run, docs.schema)
        texts = docs.select(column(docs, "text"))
        found = mapped(texts, run, texts.schema)
        part = written(found.select(digest(found).alias("digest")).distinct(), "tiling-digests")
        shared.destroy()
        hit = part if hit is None else hit.unionByName(part)
    # a null text has no matches, and its digest none to meet
    return docs.join(hit, digest(docs) == hit["digest"], "left_anti")
