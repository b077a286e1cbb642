"""Source divergence audit: how the terms of each source differ from the other sources of its language, and which terms stand out.

The counts of a language form a matrix of groups (sources) by terms, most of it zero. Spark counts the cells, numbers the groups of a
language and deals the terms into blocks of about ``COLUMNS``; the groups are cut into tiles of ``TILE`` rows, and every pair of tiles meets in
every block. There each tile's cells become K-squared trees: per level one bit per quadrant of the nodes that hold anything, children found
by rank. Both trees are walked jointly, all pairs of groups at once: a quadrant that is empty in both costs one multiplication, since all its
cells have the price of a zero count; only leaves that hold a count in either tree are priced one by one. Partial sums per pair of groups are
added up by Spark.

All numbers are exact integers. Null text, lang and source are read as ''; other columns are not read. A language without kept terms gives
pairs of value 0; an empty table gives no rows. Rows that repeat count as often as they occur.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import shipped, written
from .text import column, mapped, read, slices

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
COLUMNS, TILE = 4096, 128
HELD_TERMS = 400_000
FRONTIER = 1 << 18

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed in each task; a row without term says that the group occurs."""
    def run(batches):
        occurrences: dict[tuple[str, str], Counter] = {}
        holders: dict[tuple[str, str], Counter] = {}

        def rows():
            held = [(lang, source, term, n, holders[lang, source][term]) for (lang, source), found in occurrences.items() for term, n in found.items()]
            groups = [(lang, source, None, 0, 0) for lang, source in occurrences]
            occurrences.clear()
            holders.clear()
            lang, source, term, n, docs = zip(*(held + groups))
            terms = pa.array([t if t is None else t.decode() for t in term], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                              ["lang", "source", "term", "n", "docs"])
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                group = lang or "", source or ""
                own, seen = occurrences.setdefault(group, Counter()), set()
                for piece in slices((text.as_py() or "").encode().translate(_TERM_BYTES)):
                    found = piece.split()
                    own.update(found)
                    seen.update(found)
                holders.setdefault(group, Counter()).update(seen)
            if sum(map(len, occurrences.values())) > HELD_TERMS:
                yield rows()
        if occurrences:
            yield rows()
    texts = docs.select(*[column(docs, c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return mapped(texts, run, "lang string, source string, term string, n long, docs long")


# the matrix of one block of terms ---------------------------------------------------------------------------------------------------------

def price(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division, so that no product leaves 64 bits."""
    left, by = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * np.asarray(terms, np.int64)
    out = left // by
    left = left % by
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // by
        left = left % by
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def interleaved(row: np.ndarray, col: np.ndarray, bits: int) -> np.ndarray:
    """Quadrant path of a cell: two bits per level, the row's first."""
    out = np.zeros(len(row), np.int64)
    for k in range(bits - 1, -1, -1):
        out = out << 2 | (row >> k & 1) << 1 | (col >> k & 1)
    return out


class K2Tree:
    """A forest of K-squared trees side by side: squares of ``2 ** bits`` rows and columns.

    ``bits_at[l]`` has four bits per node of level l, ``rank_at[l]`` the number of set bits up to each: a child's place in the next level.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, count: np.ndarray, squares: int, bits: int):
        path = (col >> bits) << 2 * bits | interleaved(row, col & (1 << bits) - 1, bits)
        order = np.argsort(path)
        path, self.count = path[order], count[order]
        levels = [np.unique(path >> 2 * (bits - k)) for k in range(bits)] + [path]
        self.root = np.full(squares, -1, np.int64)
        self.root[levels[0]] = np.arange(len(levels[0]))
        self.bits_at, self.rank_at = [], []
        for above, below in zip(levels, levels[1:]):
            held = np.zeros(4 * len(above), bool)
            held[4 * np.searchsorted(above, below >> 2) + (below & 3)] = True
            self.bits_at.append(held)
            self.rank_at.append(np.cumsum(held) - 1)

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Place of a child in the next level, -1 where it (or ``node``) is empty."""
        if not len(self.bits_at[level]):
            return np.full(len(node), -1, np.int64)
        at = np.maximum(node, 0) * 4 + quadrant
        return np.where((node >= 0) & self.bits_at[level][at], self.rank_at[level][at], -1)


def divergences(x: K2Tree, y: K2Tree, x_totals: np.ndarray, y_totals: np.ndarray, terms: int, columns: int, bits: int, same: bool) -> np.ndarray:
    """Summed gaps of every row of ``x`` with every row of ``y`` over ``columns`` columns; with ``same`` only above the diagonal."""
    n, m, side = len(x_totals), len(y_totals), 1 << bits
    out, empty = np.zeros(n * m, np.int64), [np.zeros((1 << level, 1 << level), np.int64) for level in range(bits + 1)]
    squares = np.arange(-(-columns // side), dtype=np.int64)
    zero = np.zeros(len(squares), np.int64)
    stack = [(0, x.root[squares], y.root[squares], zero, zero, squares)]
    while stack:
        level, a, b, i, j, c = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, *(v[:half] for v in (a, b, i, j, c))), (level, *(v[half:] for v in (a, b, i, j, c)))]
            continue
        width = 1 << bits - level
        bare = (a < 0) & (b < 0)
        if bare.any():
            real = np.minimum((c[bare] + 1) * width, columns) - c[bare] * width
            np.add.at(empty[level], (i[bare], j[bare]), real)
            a, b, i, j, c = (v[~bare] for v in (a, b, i, j, c))
        if not len(a):
            continue
        if level == bits:
            counts = [np.where(node >= 0, t.count[node], 0) if len(t.count) else np.zeros(len(node), np.int64) for t, node in ((x, a), (y, b))]
            np.add.at(out, i * m + j, gap(price(counts[0], x_totals[i], terms), price(counts[1], y_totals[j], terms)))
            continue
        step, children = width // 2, []
        for di, dj, dc in ((u, v, w) for u in (0, 1) for v in (0, 1) for w in (0, 1)):
            ii, jj, cc = 2 * i + di, 2 * j + dj, 2 * c + dc
            inside = (ii * step < n) & (jj * step < m) & (cc * step < columns)
            if same:
                inside &= (ii <= jj) if step > 1 else (ii < jj)
            children.append((x.child(level, a[inside], np.int64(2 * di + dc)), y.child(level, b[inside], np.int64(2 * dj + dc)), ii[inside], jj[inside], cc[inside]))
        stack.append((level + 1, *(np.concatenate(v) for v in zip(*children))))
    zeros = empty[0]
    for found in empty[1:]:
        zeros = zeros.repeat(2, 0).repeat(2, 1) + found
    none = gap(price(0, x_totals, terms)[:, None], price(0, y_totals, terms)[None, :])
    return out.reshape(n, m) + zeros[:n, :m] * none


def _meeting(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Rows of two tiles in one block of terms: cells (term given) and the groups of both tiles (term null)."""
    lang, x_tile, y_tile = (key[k].as_py() for k in (0, 2, 3))
    term, number = table.column("term").combine_chunks(), np.asarray(table.column("number"), np.int64)
    total, n = np.asarray(table.column("total"), np.int64), np.asarray(table.column("n"), np.int64)
    is_cell = ~np.asarray(term.is_null())
    terms = int(table.column("terms")[0].as_py())
    codes = term.filter(pa.array(is_cell)).dictionary_encode()
    # terms of the block that neither tile holds are columns too, and empty
    col, columns = np.asarray(codes.indices, np.int64), int(table.column("columns").combine_chunks().drop_null()[0].as_py())
    sides = []
    for tile in (x_tile, y_tile):
        mine = number // TILE == tile
        group, totals = number[mine & ~is_cell] - tile * TILE, total[mine & ~is_cell]
        sides.append((totals[np.argsort(group)], number[is_cell] // TILE == tile, tile))
    bits = max(1, int(max(len(s[0]) for s in sides) - 1).bit_length())
    squares = -(-columns // (1 << bits))
    trees = [K2Tree(number[is_cell][m] - tile * TILE, col[m], n[is_cell][m], squares, bits) for _, m, tile in sides]
    out = divergences(*trees, sides[0][0], sides[1][0], terms, columns, bits, x_tile == y_tile)
    i, j = np.triu_indices(len(out), 1) if x_tile == y_tile else (v.ravel() for v in np.indices(out.shape))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(i + x_tile * TILE, pa.int64()), "j": pa.array(j + y_tile * TILE, pa.int64()),
                     "value": pa.array(out[i, j], pa.int64())})


# the report -------------------------------------------------------------------------------------------------------------------------------

def _price(count: str, total: str) -> Column:
    return F.expr(f"CAST(CAST({SCALE} * CAST({count} + 2 AS DECIMAL(28, 0)) AS DECIMAL(38, 0)) div CAST({total} + 2 * terms AS DECIMAL(20, 0)) AS BIGINT) + 1")


def matrix(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Cells (lang, source, term, n, lang_n) of the kept terms, and groups (lang, source, number, groups, total, lang_total, terms)."""
    cells = written(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-cells")
    term = Window.partitionBy("lang", "term")
    kept = (cells.filter("term IS NOT NULL").withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)})
            .filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"))
    kept = written(kept, "audit-kept")
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = (cells.filter("term IS NULL").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(terms, "lang", "left").fillna(0, ["total", "lang_total", "terms"]))
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({"number": (F.row_number().over(lang.orderBy("source")) - 1).cast("long"), "groups": F.count(F.lit(1)).over(lang)})
    return kept, written(groups, "audit-groups")


def pairs(cells: DataFrame, groups: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """(lang, source, item, value): the divergence of each group from each other one of its language."""
    tiles = F.expr(f"ceil(groups / {TILE}) - 1")
    # each tile meets every tile of its language, itself included
    placed = lambda df: (df.withColumn("tile", F.expr(f"number div {TILE}")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles)))
                         .withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}))
    own = cells.join(groups.select("lang", "source", "number", "groups", "total", "terms"), ["lang", "source"])
    own = own.filter("groups > 1").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / columns)))
    blocks = own.groupBy("lang", "block", "term").agg(F.lit(1).alias("one")).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("columns"))
    heads = groups.filter("groups > 1").join(blocks, "lang").withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})
    fields = ["lang", "block", "x", "y", "term", "number", "n", "total", "terms", "columns"]
    met = placed(own.withColumn("columns", F.lit(None).cast("long"))).select(fields).unionByName(placed(heads).select(fields))
    shipped(cells.sparkSession)
    found = met.groupBy("lang", "block", "x", "y").applyInArrow(_meeting, "lang string, i long, j long, value long")
    found = found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    # a language without terms has pairs too, of value 0
    bare = groups.filter("terms = 0").withColumn("j", F.explode(F.expr("filter(sequence(0L, groups - 1), o -> o > number)"))) \
        .select("lang", F.col("number").alias("i"), "j", F.lit(0).cast("long").alias("value"))
    found = written(found.unionByName(bare), "audit-pairs")
    named = lambda at, name: groups.select("lang", F.col("number").alias(at), F.col("source").alias(name))
    both = found.join(named("i", "a"), ["lang", "i"]).join(named("j", "b"), ["lang", "j"])
    return both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def distinctive(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms more frequent in a group than in its language, with their gap."""
    rows = cells.join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    rows = rows.withColumns({"p": _price("n", "total"), "q": _price("lang_n", "lang_total")}).filter("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    cells, groups = matrix(docs, least_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pairs(cells, groups, columns).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    term = distinctive(cells, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank"))
    return pair.unionByName(term.filter(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
                  row_number() OVER () AS id FROM documents),
w AS (SELECT lang, source, id, unnest(terms) AS term FROM t),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM t),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
m AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.terms) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.terms) AS q
      FROM s JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pa AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
x AS (SELECT lang, source, 'pair' AS part, item, value FROM pa
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM m WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM x QUALIFY part = 'pair' OR rank <= 10
"""
