"""The n-gram Jaccard join against all pairs."""

import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadlens.llm import ngram_join
from roadlens.llm.text import words
from roadlens.sources.workspace import scratch, shared_dir


def shingles(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def truth(rows, size, percent):
    """doc_id by place: (set size, smallest doc_id reachable)."""
    sets, holders = [shingles(t, size) for _, t in rows], {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for k, s in enumerate(sets):
        count = {}
        for x in s:
            for o in holders[x]:
                if o < k:
                    count[o] = count.get(o, 0) + 1
        for o, both in count.items():
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                root[find(k)] = find(o)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = [None] * len(rows)
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[k] = (rows[k][0], len(sets[k]), min(ids) if ids else None)
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_join_rows(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in entry.queries()["op1_ngram_join"](spark, f"/root/testdata/{sf}").collect()), key=str)
    assert got == truth(rows, 4, 85)


def copies(rng, n, base_words, most):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(base_words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = f"m{rng.randint(0, 10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("short,chunk", [(24, 384), (3, 7), (2, 1)])
def test_large_groups_of_near_copies(spark, short, chunk):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*copies(rng, 130, 150, 14), *copies(rng, 60, 60, 5), *[f"{passage} {t}" for t in copies(rng, 40, 30, 30)], *[passage] * 20, None, "", " \n", "a", "A", "a b", "x " * 20_000]
    rows = [(i * 3 if i % 41 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, print string").repartition(5)
    for size, percent in ((4, 85), (5, 80)):
        got = ngram_join.joined(df, size, percent, short, chunk).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted((tuple(r) for r in got), key=str) == truth(rows, size, percent)


def test_one_of_each_class_stays(spark):
    rng = random.Random(8)
    texts = list(copies(rng, 12, 200, 3))
    rows = [(5, texts[0]), (5, texts[0]), (5, texts[1]), (9, texts[2]), (None, texts[3]), (7, None), (7, None), (8, "alone here"), (None, "no id at all"), (None, "no id at all")]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, row string")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert len(kept) == 5 and sum(k[0] == 5 for k in kept) == 1 and kept.count((7, None)) == 2 and kept.count((None, "no id at all")) == 1 and (8, "alone here") in kept
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_prefixes_grow_with_cost():
    counters = np.ones(1 << 20, np.int64)
    tokens = np.sort(np.random.default_rng(1).integers(0, 2**64, 400, dtype=np.uint64))
    rare = ngram_join.Order(counters).prefix(tokens, 85)
    counters[(tokens >> np.uint64(44)).astype(int)] = 50_000
    common = ngram_join.Order(counters).prefix(tokens, 85)
    assert common[1] > rare[1] and len(common[0]) == 400 - 340 + common[1] and common[2] > rare[2]


def test_classes_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = ngram_join.classes(edges).collect()
    assert len(got) == 201 and all(r.root == 0 for r in got)


def test_members_of_a_star_wait_for_their_pivot(spark, monkeypatch):
    """Refs that are below nobody take no part in the rounds, however many pivots they have met."""
    rng, went = random.Random(4), []
    edges = [(p, 100 + i) for i in range(300) for p in rng.sample(range(6), 3)] + [(7 + i, 8 + i) for i in range(9)] + [(50, 60), (60, 50), (61, 61)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    rounds = ngram_join._rounds
    monkeypatch.setattr(ngram_join, "_rounds", lambda df: went.append({frozenset((r.a, r.b)) for r in df.collect()}) or rounds(df))
    got = {r.ref: r.root for r in ngram_join.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    nearest = {v: v for e in edges for v in e}
    for _ in nearest:
        before = dict(nearest)
        for a, b in edges:
            nearest[a] = nearest[b] = min(nearest[a], nearest[b])
        if before == nearest:
            break
    assert got == nearest
    assert not any(100 <= v < 400 for e in went[0] for v in e)


def test_texts_are_merged_at_every_size(spark):
    texts = spark.createDataFrame([(1, "a b"), (None, "c"), (2, "d"), (2, "e")], "doc_id long, text string").alias("d")
    wanted = spark.createDataFrame([(10, 10, False, b"x", 1), (11, 10, False, b"y", None), (12, 12, True, b"z", 2)], "ref long, root long, large boolean, print binary, doc_id long")
    found = ngram_join.texts_at(texts, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.ref, r.root, r.large, r.text) for r in found.collect()) == [(10, 10, False, "a b"), (11, 10, False, "c"), (12, 12, True, "d"), (12, 12, True, "e")]


def test_copies_in_many_tasks_are_listed_once(spark, monkeypatch):
    """Equal sets are listed, and so paired, by one number alone, however many tasks have met them."""
    rng, went = random.Random(3), []
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(30)]
    rows = [(1000 * k + i, t) for k in range(9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(9, "doc_id")
    met = ngram_join.met

    def seen(packed, short):
        refs = {int(r) for x in packed.collect() for r in ngram_join.entries_unpacked(bytes(x.entries))["ref"]}
        went.append(len(refs))
        return met(packed, short)
    monkeypatch.setattr(ngram_join, "met", seen)
    got = ngram_join.joined(df, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert went == [30]
    assert sorted((tuple(r) for r in got), key=str) == truth(rows, 4, 85)


def test_intermediates_and_shuffles_go(spark):
    """Of tables the result alone is left, and no shuffle of a job inside; the session's own setting is found again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    top = Path(shared_dir(spark).removeprefix("file:")) / "roadlens" / spark.sparkContext.applicationId
    there, before = {p.name for p in top.glob("*")}, spark.conf.get(setting, None)
    df = spark.createDataFrame([(i, f"a b c d e f g {i % 7}") for i in range(50)], "doc_id long, text string").repartition(3)
    found = ngram_join.joined(df, 4, 85)
    left = {p.name for p in top.glob("*")} - there
    assert len(left) == 1 and left.pop().startswith("join-joined") and spark.conf.get(setting, None) == before
    assert found.count() == 50
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: shuffles.getAllFiles().mkString("|").count("shuffle_")
    many = files()
    with scratch(spark):
        assert df.groupBy("text").count().count() == 7 and df.groupBy("doc_id").count().count() == 50
    end = time.time() + 20  # they are removed in the background
    while files() > many and time.time() < end:
        time.sleep(0.2)
    assert files() <= many
