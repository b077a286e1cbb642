"""Phrase mining by top-order marginalisation against plain counting and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import oracle_check
from roadlens.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    out = {}
    for text, lang in rows:
        own = out.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own[()] += len(w)
            own.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return out


def truth(rows, least, top):
    out = set()
    for lang, f in counts(rows).items():
        phrases = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in phrases.items():
            inside = lambda q: len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))  # noqa: E731, B023
            if any(100 * n >= 80 * a for q, n in phrases.items() if inside(q)):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, rank, p.decode(), -a, l, r, f[()], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}
    return out


def test_against_sql(spark):
    name, sf = "op12_collocations", "/root/testdata/sf0.001"
    ok, detail = oracle_check.compare(spark, oracle_check.connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, detail


@pytest.mark.parametrize("share,per_part,chunk", [(4096, 1_000_000, 1_000_000), (12, 700, 900), (3, 100, 50)])
def test_counts_survive_cutting_and_spreading(spark, share, per_part, chunk, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "Öl", "öl", "e\x1ff", *[f"w{k}" for k in range(60)]]
    weights = [60, 50, 40, 20, 20, 10, *[1] * 60]
    line = lambda: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in rng.choices(vocabulary, weights, k=rng.randint(0, 30)))
    rows = [(line(), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(500)]
    rows += [(None, "en"), ("", "xx"), (" .\n", "xx"), ("hot pair " * 4000, "en")] + [("same words here again", "fr")] * 7 + [("x y x y x y x y", "fr")] * 3
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], "text string, lang string, n long, w1 string").repartition(4)
    for least, top in ((7, 2000), (3, 15)):
        got = [tuple(r)[:8] for r in collocations.collocations(df, least, top=top, share=share, per_part=per_part).collect()]
        assert len(got) == len(set(got)) and set(got) == truth(rows, least, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_lead_columns_end_with_the_piece():
    tokens = np.array([1, 2, 0, 3, 4, 5, 6, 7, 0], np.int64)
    assert [c.tolist() for c in collocations.lead(tokens)] == [[1, 2, 3, 4, 5, 6, 7], [2, 0, 4, 5, 6, 7, 0], [0, 0, 5, 6, 7, 0, 0], [0, 0, 6, 7, 0, 0, 0]]
