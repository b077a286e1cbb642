"""Words, stable hashes and Arrow batches: the small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import shipped

SPACES = b" \t\n\x0b\x0c\r"
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(64)], dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased (bytes know no other case and no other white space)."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered. Forgotten as a whole at ``limit`` words, so memory stays bounded; hashes never change."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers: makes sums of hashes look random in every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per window of ``size`` words; none where there are fewer words."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = h[:n] * _MULTIPLIERS[0]
    for i in range(1, size):
        total = total + h[i:i + n] * _MULTIPLIERS[i % 64]
    return mixed(total)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter, non-empty sequence is one shingle of its own."""
    if 0 < len(h) < size:
        return mixed((h * _MULTIPLIERS[:len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    return np.unique(windows(h, size))


def slices(data: bytes, cut: bytes = b" ", size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces that end at a ``cut``, so that a long text is never held as one list of words."""
    start = 0
    while len(data) - start > size:
        end = data.find(cut, start + size)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:]


def column(df: DataFrame, name: str):
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(fn, schema)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
