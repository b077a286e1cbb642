"""The Katz model against a plain implementation, and its probabilities against their sum."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from roadlens.llm import katz
from roadlens.llm.text import words


def discount(n):
    d = {}
    for r in range(1, 6):
        d[r] = 1.0
        if n[1] and 6 * n[6] / n[1] < 1 and n[r]:
            v = ((r + 1) * n[r + 1] / (r * n[r]) - 6 * n[6] / n[1]) / (1 - 6 * n[6] / n[1])
            d[r] = v if 0 < v < 1 else 1.0
    return lambda r: d.get(r, 1.0) * r


class Plain:
    def __init__(self, rows):
        self.docs = [(i, [*words(t), b"\n"], i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
        train = [["", *t] for _, t, out in self.docs if not out]
        self.c, self.pairs = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
        self.n = sum(self.c.values())
        self.d1, self.d2 = discount(Counter(self.c.values())), discount(Counter(self.pairs.values()))
        left = self.n - sum(map(self.d1, self.c.values()))
        self.norm = self.n if left > 1e-9 else self.n + 1
        self.unknown = (left if left > 1e-9 else 1) / max(1, self.norm)
        self.after, self.seen = defaultdict(list), Counter()
        for (h, w), r in self.pairs.items():
            self.after[h].append(w)
            self.seen[h] += r

    def word(self, w):
        return self.d1(self.c[w]) / self.norm if w in self.c else self.unknown

    def p(self, w, h):
        if h not in self.after:
            return self.word(w)
        n = self.seen[h]
        left = 1 - sum(self.d2(self.pairs[h, x]) for x in self.after[h]) / n
        scale = 1.0
        if left < 1e-9:
            scale = n / (n + 1)
            left = 1 / (n + 1)
        if self.pairs[h, w]:
            return scale * self.d2(self.pairs[h, w]) / n
        return left / (1 - sum(map(self.word, self.after[h]))) * self.word(w)

    def rows(self):
        memo, k = {}, len(self.c)
        for i, t, out in self.docs:
            score = 0.0
            for h, w in zip(["", *t], t):
                if (h, w) not in memo:
                    memo[h, w] = math.log10(self.p(w, h))
                score += memo[h, w]
            yield i, out, len(t), sum(w in self.c for w in t), self.n, sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (k + 1))) for w in t), score


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9), (a, b)


def test_scores(spark):
    sf = "/root/testdata/sf0.001"
    same(entry.queries()["op10_katz"](spark, sf).collect(), Plain(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()).rows())


@pytest.mark.parametrize("limit,entries", [(10**6, 10**6), (50, 40), (1, 10)])
def test_small_blocks_and_partitions(spark, limit, entries):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(["the cat sat", "The dog sat on the mat", None, "", "the the the the the the", "a", "new words here", "the cat sat"] * 9)]
    rows += [(1000 + i, f"x{i % 3} y{i % 5} the z{i % 7} end{i}") for i in range(40)] + [(5000, "w " * 3000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int").repartition(3)
    same(katz.modelled(df, limit, entries)[0].collect(), Plain(rows).rows())


def test_probabilities_sum_to_one():
    for text in (["a b c a b d a", "b a a e f g h i j k a b", "a a c c d"], ["a b"], ["a a a a"]):
        m = Plain([(i, t) for i, t in enumerate(text, 1)])
        for h in [*m.after, "never seen"]:
            assert math.isclose(sum(m.p(w, h) for w in [*m.c, "unknown"]), 1, rel_tol=1e-12)


def test_no_training_and_no_rows(spark):
    only = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = katz.modelled(spark.createDataFrame([(only, "some words")], "doc_id long, text string"))[0].collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)
    assert katz.modelled(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_packed_arrays():
    arrays = [np.arange(5, dtype="<u4"), np.array([], "<f8"), np.array([2**63 + 5, 1], "<u8"), np.array([1.5, -2.0])]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))))
