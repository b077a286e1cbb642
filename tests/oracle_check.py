"""Runs registered queries and their SQL side by side: python tests/oracle_check.py <sf> [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("roadlens-check").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return v


def compare(spark, con, sf_dir, fn, sql):
    """(ok, detail): same column names, same multiset of rows, values equal exactly."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    if sql is None:
        return bool(ours), f"rows={sum(ours.values())}"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return False, f"columns {names} vs {sorted(cols)}"
    order = [cols.index(n) for n in names]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in rel.fetchall())
    if ours == theirs:
        return True, f"rows={sum(ours.values())}"
    a, b = list((ours - theirs).elements()), list((theirs - ours).elements())
    return False, f"rows {sum(ours.values())} vs {sum(theirs.values())}; {len(a)} only ours; {names}\n   ours  {sorted(a, key=str)[:3]}\n   other {sorted(b, key=str)[:3]}"


def main(argv):
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = []
    for name in names:
        t = time.time()
        try:
            ok, detail = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, detail = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {'sql ' if name in oracles else 'rows'} {time.time() - t:5.1f}s {detail}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} match", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
