"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, tables in partitions.

Tokens are words (A-Z lower-cased) and one end per document; a document's first token follows a begin mark. The model has two orders:

    P(w | h) = scale(h) * d(r) * r / c(h)     if (h, w) was seen r > 0 times in training
             = alpha(h) * P(w)                otherwise (alpha = 1 for an h never seen)
    P(w)     = d(c) * c / N                   if w was seen c > 0 times, else the unknown word's mass: what the discounts leave

d is Katz's Good-Turing discount for counts up to ``CUTOFF`` (1 above, and 1 wherever the counts of counts give no discount between 0 and
1). alpha(h) makes the probabilities after h, the unknown word's included, sum to one; if the discounts leave nothing, one part in c(h) + 1 is
kept back by scale(h).

Nothing that grows with the corpus is broadcast or brought to the driver. Documents are encoded once into blocks of a bounded number of
tokens; a block asks for what it needs (word counts, pair counts, backoff weights) with one packed, sorted array per partition of the
asked table, and gets an array of the same order back. A pair is placed by its history, a frequent history's pairs by both words, so no
partition is hot. Tables and answers are written below the shared folder.

Defined cases: null and empty texts are one end token; a null doc_id counts as training; repeated rows are learned and scored one by one; with
no training rows every token has the unknown word's probability, one; empty input gives an empty result; further columns are not read. Words are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import shipped, written
from .text import WordHashes, column, mapped, read, words

CUTOFF = 5
BLOCK_TOKENS, PART_ENTRIES = 1_500_000, 2_500_000
END = np.uint64(0xE5D0F7E47)
ANSWER = "kind string, part int, block long, payload binary"
Batches = Iterator[pa.RecordBatch]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; each is stored by byte planes, which suits sorted and small numbers."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        data = zlib.compress(planes.tobytes(), 1)
        out.append(b"%s%d,%d;" % (a.dtype.str.encode(), len(a), len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        head = data[at:data.index(b";", at)].decode()
        n, size = head[3:].split(",")
        at += len(head) + 1
        kind = np.dtype(head[:3])
        planes = np.frombuffer(zlib.decompress(data[at:at + int(size)]), np.uint8).reshape(kind.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(int(n)))
        at += int(size)
    return out


def rows(kind: list[str], part: list[int], block: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())],
                                      ["kind", "part", "block", "payload"])


# blocks ----------------------------------------------------------------------------------------------------------------------------------

BLOCK = "block long, doc_ids array<bigint>, lengths array<int>, training array<boolean>, vocabulary binary, tokens binary, n_tokens long, n_words long"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def blocks(docs: DataFrame, limit: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as word numbers of their block's own vocabulary (sorted hashes, with training counts)."""
    def emitted(number, ids, parts):
        lengths = [len(p) for p in parts]
        training = np.array([not held_out(i) for i in ids], bool)
        vocabulary, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(tokens, np.repeat(training, lengths), len(vocabulary)).astype("<u4")
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        values = [number, ids, lengths, training.tolist(), pack(vocabulary, counts), pack(tokens.astype("<u4")), len(tokens), len(vocabulary)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in BLOCK.split(", ")])
    hashes = WordHashes()

    def run(batches):
        number, ids, parts, n = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                parts.append(np.append(hashes.of(words(text.as_py())), END))
                n += len(parts[-1])
                if n >= limit:
                    yield emitted(number, ids, parts)
                    number, ids, parts, n = number + 1, [], [], 0
        if parts:
            yield emitted(number, ids, parts)
    return mapped(docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text")), run, BLOCK)


# words -----------------------------------------------------------------------------------------------------------------------------------

def word_tables(encoded: DataFrame, bits: int) -> DataFrame:
    """By ranges of the word hash (``2 ** bits`` of them): the table of words and training counts, each block's answer (places in the table, counts), totals."""
    shift = np.uint64(64 - bits)

    def ask(batches):
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("vocabulary")):
                word, count = unpack(packed.as_py())
                part = (word >> shift).astype(np.int64) if bits else np.zeros(len(word), np.int64)
                edges = np.flatnonzero(np.diff(part)) + 1
                asked = [pack(w, c) for w, c in zip(np.split(word, edges), np.split(count, edges))]
                yield rows(["ask"] * len(asked), part[np.append(0, edges)].tolist(), [block] * len(asked), asked)

    def answer(key: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        block, found = [], []
        for batch in batches:
            block += batch.column("block").to_pylist()
            found += [unpack(p.as_py()) for p in batch.column("payload")]
        word, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        total = np.bincount(place, np.concatenate([f[1] for f in found]), len(word)).astype("<u8")
        part, at = key[0].as_py(), 0
        yield rows(["words", "totals"], [part] * 2, [-1] * 2, [pack(word, total), pack(np.array([len(word), total.sum(), (total > 0).sum(), *counts_of_counts(total)], "<i8"))])
        for b, f in zip(block, found):
            own = place[at:at + len(f[0])]
            at += len(f[0])
            yield rows(["word"], [part], [b], [pack(own.astype("<u4"), total[own])])
    asked = mapped(encoded.select("block", "vocabulary"), ask, ANSWER)
    return written(asked.groupBy("part").applyInArrow(answer, ANSWER), "katz-words")


def counts_of_counts(total: np.ndarray) -> list[int]:
    return [int((total == r).sum()) for r in range(1, CUTOFF + 2)]


def discounts(n: list[int]) -> np.ndarray:
    """Factor by count: index 0 is 0, 1 to CUTOFF are Katz's, the last stands for all larger counts."""
    d = np.ones(CUTOFF + 2)
    d[0] = 0
    if n[0] > 0:
        large = (CUTOFF + 1) * n[CUTOFF] / n[0]
        for r in range(1, CUTOFF + 1):
            if n[r - 1] > 0 and large < 1:
                v = ((r + 1) * n[r] / (r * n[r - 1]) - large) / (1 - large)
                if 0 < v < 1:
                    d[r] = v
    return d


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, CUTOFF + 1).astype(np.int64)] * count


class Unigrams:
    """Probabilities of words by their training count; the unknown word has what the discounts leave."""

    def __init__(self, tokens: int, known: int, n: list[int]):
        self.tokens, self.known, self.d = tokens, known, discounts(n)
        left = float(sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, CUTOFF + 1)))
        self.norm = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1.0) / max(self.norm, 1)

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(self.d, count) / max(self.norm, 1), self.unknown)


# pairs -----------------------------------------------------------------------------------------------------------------------------------

class Block:
    """A block with its words' places in the table and their counts."""

    def __init__(self, row: dict, answers: dict[str, list[bytes]], offsets: np.ndarray, begin: int, trained: int):
        self.number, self.ids, self.lengths = row["block"], row["doc_ids"], np.array(row["lengths"], np.int64)
        self.training = np.array(row["training"], bool)
        self.tokens = unpack(row["tokens"])[0].astype(np.int64)
        places, counts = [], []
        for part, payload in answers["word"]:
            place, count = unpack(payload)
            places.append(offsets[part] + place)
            counts.append(count)
        # the begin mark is one more word, after all others
        self.word = np.append(np.concatenate(places), begin).astype("<u4")
        self.count = np.append(np.concatenate(counts), trained).astype("<u8")
        self.begin = len(self.word) - 1

    def pairs(self, parts: int, hot: int):
        """(part, history, word, training count, index of each token's pair): distinct pairs in the order of partition, history, word (block numbers)."""
        history = np.append(self.begin, self.tokens[:-1])
        history[np.cumsum(self.lengths)[:-1]] = self.begin
        key, inverse = np.unique(history * len(self.word) + self.tokens, return_inverse=True)
        count = np.bincount(inverse, np.repeat(self.training, self.lengths), len(key)).astype("<u4")
        h, w = key // len(self.word), key % len(self.word)
        place = self.word[h].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place = np.where(self.count[h] > hot, place ^ (self.word[w].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), place)
        part = ((place >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return part[order], h[order], w[order], count[order], back[inverse]


def with_answers(encoded: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with its answers, in the order of their partitions."""
    own = answers.filter("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "part", "payload"))).alias("answers"))
    return encoded.drop("vocabulary", "n_tokens", "n_words").join(own, "block")


def read_blocks(batches, offsets, begin, trained):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            answers: dict[str, list] = {}
            for a in row["answers"]:
                answers.setdefault(a["kind"], []).append((a["part"], bytes(a["payload"])))
            yield Block(row, answers, offsets, begin, trained), answers


def pair_tables(joined: DataFrame, parts: int, hot: int, offsets: np.ndarray, begin: int, trained: int) -> DataFrame:
    """By partition: the table of seen pairs (history, word, count, the word's own count), each block's answer (counts), counts of counts."""
    def ask(batches):
        for block, _ in read_blocks(batches, offsets, begin, trained):
            part, h, w, count, _ = block.pairs(parts, hot)
            edges = np.flatnonzero(np.diff(part)) + 1
            columns = [np.split(a, edges) for a in (block.word[h], block.word[w], count, block.count[w])]
            asked = [pack(*c) for c in zip(*columns)]
            yield rows(["ask"] * len(asked), part[np.append(0, edges)].tolist(), [block.number] * len(asked), asked)

    def answer(key: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        block, size, keys, counts, own = [], [], [], [], []
        for batch in batches:
            block += batch.column("block").to_pylist()
            for p in batch.column("payload"):
                h, w, c, cw = unpack(p.as_py())
                keys.append(h.astype(np.uint64) << np.uint64(32) | w)
                counts.append(c)
                own.append(cw.astype("<u4"))
                size.append(len(h))
        pair, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(pair)).astype("<u4")
        seen, part = total > 0, key[0].as_py()
        yield rows(["pairs", "pair-totals"], [part] * 2, [-1] * 2, [
            pack((pair[seen] >> np.uint64(32)).astype("<u4"), pair[seen].astype("<u4"), total[seen], np.concatenate(own)[first][seen]),
            pack(np.array(counts_of_counts(total), "<i8"))])
        at = 0
        for b, n in zip(block, size):
            yield rows(["pair"], [part], [b], [pack(total[place[at:at + n]])])
            at += n
    return written(mapped(joined, ask, ANSWER).groupBy("part").applyInArrow(answer, ANSWER), "katz-pairs")


# backoff weights -------------------------------------------------------------------------------------------------------------------------

def weights(pairs: DataFrame, asked: DataFrame, d: np.ndarray, unigrams: Unigrams, width: int) -> DataFrame:
    """By ranges of the history: the table of backoff weights, and each block's answer (weight and scale of each of its words)."""
    def partial(batches):
        for batch in batches:
            for p in batch.column("payload"):
                h, _, r, cw = unpack(p.as_py())
                if not len(h):
                    continue
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                values = [np.add.reduceat(v, first) for v in (r.astype(np.float64), discounted(d, r), unigrams.of(cw))]
                h = h[first]
                part = (h // width).astype(np.int64)
                edges = np.flatnonzero(np.diff(part)) + 1
                out = [pack(*c) for c in zip(*[np.split(v, edges) for v in (h, *values)])]
                yield rows(["sum"] * len(out), part[np.append(0, edges)].tolist(), [-1] * len(out), out)

    def answer(key: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        part, asks = key[0].as_py(), []
        n, seen, mass = np.zeros(width), np.zeros(width), np.zeros(width)
        for batch in batches:
            for kind, block, p in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), batch.column("payload")):
                found = unpack(p.as_py())
                if kind == "ask":
                    asks.append((block, found[0].astype(np.int64) - part * width))
                    continue
                at = found[0].astype(np.int64) - part * width
                for total, v in zip((n, seen, mass), found[1:]):
                    total[at] += v
        alpha, scale = backoff(n, seen, mass)
        at = np.flatnonzero(n)
        yield rows(["weights"], [part], [-1], [pack((at + part * width).astype("<u4"), alpha[at], scale[at])])
        for block, own in asks:
            yield rows(["weight"], [part], [block], [pack(alpha[own], scale[own])])
    sums = mapped(pairs.filter("kind = 'pairs'").select("payload"), partial, ANSWER)
    return written(sums.unionByName(asked).groupBy("part").applyInArrow(answer, ANSWER), "katz-weights")


def backoff(n: np.ndarray, seen: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale) of histories seen n times, with discounted counts ``seen`` of their words and unigram ``mass`` of the same words."""
    safe = np.maximum(n, 1)
    left = 1 - seen / safe
    none = left < 1e-9
    scale = np.where(none, safe / (safe + 1), 1.0)
    left = np.where(none, 1 - scale * seen / safe, left)
    return np.where(n > 0, left / np.maximum(1 - mass, 1e-300), 1.0), np.where(n > 0, scale, 1.0)


def asked_weights(joined: DataFrame, offsets: np.ndarray, begin: int, trained: int, width: int) -> DataFrame:
    def ask(batches):
        for block, _ in read_blocks(batches, offsets, begin, trained):
            part = (block.word // width).astype(np.int64)
            edges = np.flatnonzero(np.diff(part)) + 1
            asked = [pack(w) for w in np.split(block.word, edges)]
            yield rows(["ask"] * len(asked), part[np.append(0, edges)].tolist(), [block.number] * len(asked), asked)
    return mapped(joined.withColumn("tokens", F.lit(pack(np.zeros(0, "<u4")))), ask, ANSWER)


# scores ----------------------------------------------------------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(joined: DataFrame, parts: int, hot: int, offsets: np.ndarray, begin: int, trained: int, d: np.ndarray, unigrams: Unigrams) -> DataFrame:
    tokens, known = unigrams.tokens, unigrams.known

    def run(batches):
        for block, answers in read_blocks(batches, offsets, begin, trained):
            _, h, w, _, index = block.pairs(parts, hot)
            r = np.concatenate([unpack(p)[0] for _, p in answers["pair"]]).astype(np.float64)
            alpha, scale = (np.concatenate(v) for v in zip(*[unpack(p) for _, p in answers["weight"]]))
            unigram = unigrams.of(block.count)
            value = np.where(r > 0, scale[h] * discounted(d, r) / np.maximum(block.count[h], 1), alpha[h] * unigram[w])
            first = np.cumsum(block.lengths) - block.lengths
            count = block.count[block.tokens]
            base = np.log10((count + 0.1) / (tokens + 0.1 * (known + 1)))
            yield pa.RecordBatch.from_arrays([
                pa.array(block.ids, pa.int64()), pa.array(~block.training), pa.array(block.lengths, pa.int64()),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(len(first), tokens, np.int64)),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(value)[index], first))], [c.split()[0] for c in SCORES.split(", ")])
    return mapped(joined, run, SCORES)


def modelled(docs: DataFrame, limit: int = BLOCK_TOKENS, entries: int = PART_ENTRIES) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Scores of all documents, and the model's tables: words (with counts), pairs (with counts), weights; one packed row per partition."""
    shipped(docs.sparkSession)
    encoded = written(blocks(docs, limit), "katz-blocks")
    n_words, n_tokens = encoded.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    bits = max(3, math.ceil(math.log2(max(1, n_words / entries))))
    parts = max(8, math.ceil(n_tokens / entries))
    asked = word_tables(encoded, bits)
    totals = {r.part: unpack(bytes(r.payload))[0] for r in asked.filter("kind = 'totals'").select("part", "payload").collect()}  # one short row per partition
    sizes = np.array([totals[p][0] if p in totals else 0 for p in range(1 << bits)], np.int64)
    offsets, begin = np.cumsum(sizes) - sizes, int(sizes.sum())
    if begin >= 2**32 - 1:
        raise ValueError("more than 2**32 distinct words")
    sums = sum(totals.values(), np.zeros(3 + CUTOFF + 1, np.int64)).tolist()
    unigrams = Unigrams(sums[1], sums[2], sums[3:])
    trained = encoded.agg(F.sum(F.size(F.filter("training", lambda t: t)))).first()[0] or 0
    hot = max(1, sums[1] // (4 * parts))
    with_words = with_answers(encoded, asked)
    pairs = pair_tables(with_words, parts, hot, offsets, begin, trained)
    n = sum((unpack(bytes(r.payload))[0] for r in pairs.filter("kind = 'pair-totals'").select("payload").collect()), np.zeros(CUTOFF + 1, np.int64)).tolist()
    d, width = discounts(n), max(1024, math.ceil((begin + 1) / max(8, math.ceil(begin / entries))))
    held = weights(pairs, asked_weights(with_words, offsets, begin, trained, width), d, unigrams, width)
    answers = asked.unionByName(pairs).unionByName(held)
    out = scores(with_answers(encoded, answers), parts, hot, offsets, begin, trained, d, unigrams)
    return out, {k: t.filter(F.col("kind") == k).select("part", "payload") for k, t in (("words", asked), ("pairs", pairs), ("weights", held))}


def op10_katz(spark, sf_dir: str) -> DataFrame:
    return modelled(read(spark, sf_dir, "documents"))[0]
