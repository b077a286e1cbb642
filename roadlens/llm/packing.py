"""Packing of tokenized documents into sequences by minimum bin slack.

Every document becomes token ids and an end id; it is cut into full windows and a rest. What is left to pack is a multiset of rest lengths,
which is a histogram of at most ``capacity`` - 1 counts whatever the size of the corpus, so the packing is planned on the histogram: take the
longest length left, fill the room it leaves by subset sums over the remaining multiset (a bitset of reachable sums, one step per length,
stopped at an exact fill), trace the counts back, and repeat that filling as often as the counts allow. Each filling uses up at least one
length, so the plan stays of the order of the number of lengths. Pieces then find their place by their rank among pieces of their length.

Defined cases: null and empty texts are the end id alone; repeated rows are packed one by one; a null doc_id is kept as null; empty input
gives an empty result; only ``doc_id`` and ``text`` are read, so further columns do not matter.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .sharding import ranked
from .text import column, mapped, read

CAPACITY, END = 4096, 2
REMEMBERED = 500_000

# Plain bytes are the Latin-1 forms of printable ASCII, white space and the letters from U+00C0 on: composed already, each with one lower-case
# form. None of them lies between 0x80 and 0xBF, so no UTF-8 word that is not ASCII is plain, and the two never look alike.
_LETTERS = bytes(b for b in range(0xC0, 0x100) if b not in (0xD7, 0xF7))
_PLAIN = bytes(range(0x20, 0x7F)) + b"\t\n\x0b\x0c\r" + _LETTERS
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
# How the tokenizer cuts plain lower-case words before it merges, and the characters it merges in place of UTF-8 bytes.
_CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_BYTE_LEVEL = {b: "".join(chr(c + 162 if 0x7F <= c <= 0xA0 else 323 if c == 0xAD else c) for c in chr(b).encode()) for b in _LETTERS}


class Remembered(dict):
    """What ``made`` gives for a key, remembered up to a limit."""

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.made(key)
        return value


class PartIds(Remembered):
    """Ids of a part of a plain lower-case word, merged by the tokenizer's model."""

    def __init__(self, model):
        super().__init__()
        self.merge = model.tokenize

    def made(self, part: bytes) -> bytes:
        return as_bytes([t.id for t in self.merge(part.decode("latin-1").translate(_BYTE_LEVEL))])


class WordIds(Remembered):
    """Ids of a word as little-endian 32-bit numbers. The tokenizer never merges across white space.

    A plain word is cut as the tokenizer cuts it, and the ids of its parts are remembered too, since new words mostly are known parts with
    other marks around them; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = PartIds(self.tokenizer.model)

    def made(self, word: bytes) -> bytes:
        plain = word if not word.translate(None, _PLAIN) else latin(word.decode())
        if plain is None or b"<|" in plain:
            return as_bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, _CUT.findall(plain.translate(_LOWER))))

    def of(self, text: str | None) -> bytes:
        data = latin(text or "")
        # the tokenizer lower-cases; doing so for plain texts first makes more words alike (special tokens keep their case)
        data = text.encode() if data is None or b"<|" in data else data.translate(_LOWER)
        return b"".join(map(self.__getitem__, data.split()))


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def latin(text: str) -> bytes | None:
    """The text in Latin-1 if it is plain."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, _PLAIN) else data


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its ids (32-bit, little-endian) if asked for."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    last = np.array([end], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    known: list[WordIds] = []  # one per Python worker

    def run(batches):
        if not known:
            known.append(WordIds(path))
        words = known[0]
        for batch in batches:
            doc, out, raw = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = words.of(text) + last
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    doc.append(i)
                    out.append((start, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        raw.append(part)
            cols = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)]
            arrays = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *cols] + ([pa.array(raw, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return mapped(docs.select(column(docs, "doc_id"), column(docs, "text")), run, schema)


def filling(left: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each, from the multiset ``left``, with the largest sum up to ``room``."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        steps.append((length, bits))
        most, times = min(left[length], room // length), 1
        while most > 0:  # binary splitting of the count
            now = min(times, most)
            bits |= (bits << (length * now)) & mask
            most, times = most - now, times * 2
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            used[length] = n
    return used


def planned(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, lengths and how often each in one sequence), all of ``histogram`` used up."""
    left, plan = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = filling({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, used))
    return plan


PLACES = "length long, first long, last long, sequence long, per_sequence long, at long"


def places(plan: list[tuple[int, dict[int, int]]]) -> tuple[list[tuple], int]:
    """Rows of PLACES (ranks ``first`` to ``last`` of a length lie in sequences from ``sequence`` on, ``per_sequence`` each), and the number of sequences."""
    rows, sequence, rank = [], 0, {}
    for times, used in plan:
        at = 0
        for length in sorted(used, reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + times * used[length]
            rows.append((length, first, rank[length] - 1, sequence, used[length], at))
            at += length * used[length]
        sequence += times
    return rows, sequence


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (a written table of pieces) with ``sequence_id`` and ``offset``."""
    numbered = ranked(found, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank", buckets=64)
    counts = dict(found.filter(F.col("length") < capacity).groupBy("length").count().collect())  # at most capacity - 1 rows
    rows, sequences = places(planned(counts, capacity))
    rest = numbered.filter(F.col("length") < capacity)
    full = numbered.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("rank") + F.lit(sequences)).withColumn("offset", F.lit(0).cast("long"))
    # the plan's size is bounded by the capacity, not by the corpus
    plan = F.broadcast(found.sparkSession.createDataFrame(rows, PLACES))
    inside = F.col("rank") - F.col("first")
    rest = rest.join(plan, (rest["length"] == plan["length"]) & F.col("rank").between(F.col("first"), F.col("last"))).drop(plan["length"]) \
        .withColumn("sequence_id", F.col("sequence") + F.floor(inside / F.col("per_sequence"))) \
        .withColumn("offset", F.col("at") + inside % F.col("per_sequence") * F.col("length"))
    return rest.select(*found.columns, "sequence_id", "offset").unionByName(full.select(*found.columns, "sequence_id", "offset"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return stage(spark, read(spark, sf_dir, "documents"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies; the tokens themselves come with ``pieces(..., with_ids=True)``."""
    out = packed(written(pieces(docs), "pieces"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
