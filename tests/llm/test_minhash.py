"""Near duplicates by min-max hashing against all pairs."""

import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from roadlens.llm import minhash
from roadlens.llm.text import WordHashes, shingle_set, words
from test_ngram_join import copies, truth


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rows(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    got = entry.queries()["op11_minhash_dedup"](spark, f"/root/testdata/{sf}").collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == truth(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_and_odd_rows(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*copies(rng, 420, 150, 12), *copies(rng, 60, 60, 4), *[f"{passage} {t}" for t in copies(rng, 40, 30, 30)], *[passage] * 20, None, "", " \n", "a", "A", "a b",
             "a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "x " * 20_000, "É é", "é É"]
    rows = [(i * 3 if i % 41 else None, t) for i, t in enumerate(texts)] + [(6, texts[2]), (6, "other text under the same number")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, print string").repartition(5)
    got = minhash.deduplicated(df).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == truth(rows, 3, 85)
    assert minhash.deduplicated(df.limit(0)).count() == 0


def test_both_ends_estimate_without_bias_and_with_less_variance():
    rng = np.random.default_rng(2)
    both, single = [], []
    for _ in range(60):
        shared, own = rng.integers(0, 2**64, 40, dtype=np.uint64), rng.integers(0, 2**64, (2, 10), dtype=np.uint64)
        x, y = (minhash.signature(np.append(shared, o)) for o in own)
        both.append(minhash.estimate(x, y))
        single.append(float(np.mean(x[0] == y[0])))
    assert abs(np.mean(both) - 2 / 3) < 0.015 and np.var(both) < np.var(single)
    s = shingle_set(WordHashes().of(words("one two three four five six seven eight nine")), 3)
    assert len(set(minhash.band_keys(s).tolist())) == minhash.BANDS and (minhash.band_keys(s[::-1]) == minhash.band_keys(s)).all()
    assert [minhash.least_size(p) for p in (80, 85, 90)] == [4, 6, 9]
