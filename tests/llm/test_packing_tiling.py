"""Packing and benchmark decontamination against brute force."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from roadlens.llm import decontaminate, packing
from roadlens.llm.text import WordHashes, words

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        want, at = ids(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            part = np.array(want[r.start:r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(part) and len(part) == 4 * r.length
            at += r.length
        assert at == len(want)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_rows(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rows = entry.queries()["op7_packing"](spark, SF).collect()
    n = check_packing(rows, texts, packing.CAPACITY)
    assert sum(r.length for r in rows) / (n * packing.CAPACITY) > 0.97


@pytest.mark.parametrize("text", ["Élan d’être", "it's WE'LL <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "H̱ ́a é", "a b c\x1cd", "ΣΑΣ İ ß", "1234 ab12", "  \n", "🙂🙂 ok"])
def test_words_are_tokenized_as_the_whole_text(text):
    assert list(np.frombuffer(packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).of(text) , "<u4")) == ids(text)[:-1]


def test_plain_words_do_not_take_the_whole_tokenizer():
    """Letters up to U+00FF are cut and merged part by part, with the ids of the whole tokenizer, and known words are not asked for again."""
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)) if c != 0xAD]
    rng, memory = random.Random(3), packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(rng.choice(letters[:94] + letters[94 + 30:94 + 95] * 2) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += letters + [f"a{c}b {c}{c}" for c in letters] + ["Éléphant l'Été", "GROẞE größe", "naïve d'ÿ ÷×", "«Où»"]
    assert all(list(np.frombuffer(memory.of(text), "<u4")) == ids(text)[:-1] for text in texts)

    class Refused:
        def encode(self, *_, **__):
            raise AssertionError("the whole tokenizer was asked")
    fresh = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    fresh.tokenizer = Refused()
    for text in ["Élan, ça où?", "Straße größer", "año Ñandú"]:
        assert list(np.frombuffer(fresh.of(text), "<u4")) == ids(text)[:-1]


def test_forgotten_words_come_back_the_same(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    memory = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = "one two three, été one “two” two. 三 one"
    assert list(np.frombuffer(memory.of(text), "<u4")) == ids(text)[:-1] and len(memory) <= 2


def test_fillings_are_closest():
    rng = random.Random(5)
    for _ in range(300):
        left = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room, sums = rng.randint(0, 40), {0}
        for k, n in left.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        used = packing.filling(left, room)
        assert all(used[k] <= left[k] for k in used) and sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
    plan = packing.planned({3: 10_000, 5: 7, 4096: 2, 4000: 3}, 4096)
    total = defaultdict(int)
    for times, used in plan:
        assert sum(k * n for k, n in used.items()) <= 4096
        for k, n in used.items():
            total[k] += times * n
    assert total == {3: 10_000, 5: 7, 4096: 2, 4000: 3} and packing.planned({}, 8) == []


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 9000, 0), (4, "b", 0), (4, "b", 0), (None, "c d e", 0)], "doc_id long, text string, length int")
    rows = packing.stage(spark, docs, "").collect()
    assert sorted(r.length for r in rows) == [1, 1, 2, 2, 4, 809, 4096, 4096] and len({r.sequence_id for r in rows}) == 3
    assert packing.stage(spark, docs.limit(0), "").count() == 0


def plain_tiles(item, doc, size):
    """The textbook greedy tiling."""
    used_i, used_j, out = set(), set(), []
    while True:
        best, found = size, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in used_i and j + k not in used_j:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not used_i & set(range(i, i + best)) and not used_j & set(range(j, j + best)):
                used_i |= set(range(i, i + best))
                used_j |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiling_against_the_textbook():
    rng, hashes = random.Random(2), WordHashes()
    for _ in range(60):
        item = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 25))]
        doc = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert decontaminate.tiles(hashes.of(item), hashes.of(doc), 3) == plain_tiles(item, doc, 3)


def test_reordered_passages_are_caught(spark):
    rng = random.Random(1)
    item = [f"w{rng.randint(0, 9999)}" for _ in range(40)]
    moved = " ".join(item[20:] + ["filler"] * 3 + item[:20])
    docs = spark.createDataFrame([(1, "x " * 30 + moved.upper(), "m"), (2, " ".join(item[:25]), "m"), (3, None, "m"), (4, "", "m"), (4, "", "m"), (None, " \n".join(item), "m"),
                                  (5, "y " * 50_000 + moved, "m")], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, " ".join(item)), (None, " ".join(item[::-1]))], "item_id long, text string")
    for limit in (10**6, 30):
        got = {(r.doc.doc_id, m.item_id) for r in decontaminate.matched(docs, bench, limit=limit).collect() for m in r.matches}
        assert got == {(d, i) for d in (1, None, 5) for i in (7, 10)}
    assert decontaminate.matched(docs, bench.limit(0)).count() == len(docs.collect()) and decontaminate.matched(docs.limit(0), bench).count() == 0


def test_blocks_are_released_one_by_one(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(12)]
    docs = spark.createDataFrame([(i, f"before {t} after", "x") for i, t in items[:6]] * 2 + [(100 + i, f"other words {i} and nothing else", "y") for i in range(6)]
                                 + [(200, None, "z"), (200, None, "z"), (None, "", "z")], "doc_id long, text string, digest string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    alive, most, made = set(), [0], spark.sparkContext.broadcast

    def broadcast(value):
        out = made(value)
        alive.add(id(out))
        most[0] = max(most[0], len(alive))
        end = out.destroy
        monkeypatch.setattr(out, "destroy", lambda *a: (alive.discard(id(out)), end(*a)))
        return out
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    found = {(r.doc.doc_id, m.item_id) for r in decontaminate.matched(docs, bench, limit=60).collect() for m in r.matches}
    assert found == {(i, i) for i in range(6)} and most == [1] and not alive
    kept = decontaminate.stage(spark, docs, f"file://{tmp_path}", limit=60)
    assert kept.columns == docs.columns and most == [1] and not alive
    one = decontaminate.stage(spark, docs, f"file://{tmp_path}")
    assert sorted(map(str, kept.collect())) == sorted(map(str, one.collect())) and kept.count() == 9


def test_decontamination_rows(spark):
    got = {(r.doc_id, r.item_id): r.covered for r in entry.queries()["op8_decontamination"](spark, SF).collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want, hashes = {}, WordHashes()
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        doc = hashes.of(words(text))
        for item_id, passage in items:
            item = hashes.of(words(passage))
            covered = sum(t[2] for t in decontaminate.tiles(item, doc))
            if covered >= 0.8 * len(item):
                want[doc_id, item_id] = covered
    assert got == want and len(want) > 2
