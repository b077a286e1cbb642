"""The source divergence audit against plain Python and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import oracle_check
from roadlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def truth(rows, least):
    rows = [((lang or "", source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {g[0] for g, _ in rows}:
        docs = Counter(t for g, found in rows if g[0] == lang for t in set(found))
        kept = {t for t, n in docs.items() if n >= least}
        counts = {g[1]: Counter() for g, _ in rows if g[0] == lang}
        for g, found in rows:
            if g[0] == lang:
                counts[g[1]].update(t for t in found if t in kept)
        whole = sum(counts.values(), Counter())
        prices = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        gap = lambda p, q: (p - q) * (p - q) // (p + q)
        priced, q = {source: prices(c) for source, c in counts.items()}, prices(whole)
        for source, own in priced.items():
            pairs = [(-sum(gap(own[t], o[t]) for t in kept), item.encode()) for item, o in priced.items() if item != source]
            terms = [(-gap(own[t], q[t]), t.encode()) for t in kept if counts[source][t] and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out |= {(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def test_against_sql(spark):
    name, sf = "op13_source_divergence", "/root/testdata/sf0.001"
    ok, detail = oracle_check.compare(spark, oracle_check.connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, detail


def test_many_sources_blocks_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(160)] + ["Öl", "ÖL", "straße", "中文", "a\x7fb"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 25))), "en", f"s{rng.randint(0, 140)}") for _ in range(500)]
    rows += [(" ".join(rng.choices(vocabulary, k=9)), rng.choice(["de", None, ""]), rng.choice(["x", None, "y"])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", None, "void"), ("1 2 3", "xx", "p"), ("...", "xx", "q"), ("only", "yy", "z"), ("Same SAME same", "en", "hot")] + [("same line", "en", "hot")] * 50
    rows += [("word " * 300_000, "en", "long")] * 2
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, n long, term string").repartition(4)
    expected = truth(rows, 3)
    for columns in (4096, 16):
        got = [tuple(r) for r in divergence.audit(df, 3, columns=columns).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,m,columns,fill", [(1, 1, 1, 1.0), (5, 9, 37, 0.1), (16, 3, 64, 0.6), (2, 2, 50, 0.0)])
def test_joint_walk(n, m, columns, fill, monkeypatch):
    monkeypatch.setattr(divergence, "FRONTIER", 64)
    rng = np.random.default_rng(n * columns)
    matrices = [np.where(rng.random((k, columns)) < fill, rng.integers(1, 10**7, (k, columns)), 0) for k in (n, m)]
    bits = max(1, (max(n, m) - 1).bit_length())
    squares = -(-columns // (1 << bits))
    trees = [divergence.K2Tree(*np.nonzero(c), c[np.nonzero(c)], squares, bits) for c in matrices]
    totals = [c.sum(1) + 5 for c in matrices]
    price = [[[1 + 10**9 * (int(v) + 2) // (int(t) + 2 * columns) for v in row] for row, t in zip(c, ts)] for c, ts in zip(matrices, totals)]
    expected = [[sum((p - q) ** 2 // (p + q) for p, q in zip(x, y)) for y in price[1]] for x in price[0]]
    assert divergence.divergences(*trees, *totals, columns, columns, bits, False).tolist() == expected


def test_prices_do_not_overflow():
    got = divergence.price(np.array([10**12]), np.array([3 * 10**12]), np.array([10**7]))
    assert got.tolist() == [1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 2 * 10**7)]
