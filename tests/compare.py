"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def compare(spark, con, name, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(v) for v in r) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None, None
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return len(got), False, f"columns {columns} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(normal(r[i]) for i in order) for r in rel.fetchall())
    diff = None
    if got != want:
        extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        diff = f"{len(got)} vs {len(want)}; extra {str(extra[:2])[:700]} missing {str(missing[:2])[:700]}"
    return len(got), got == want, diff


if __name__ == "__main__":
    from storyloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8", "compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    import __spark_entry__ as entry

    names = sys.argv[2:] or list(entry.queries())
    names = [n for n in entry.queries() if any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)] if sys.argv[2:] else names
    bad = []
    for name in names:
        start = time.time()
        try:
            n, ok, diff = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            n, ok, diff = 0, False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"\n@@ {name}: rows={n} match={ok} {time.time() - start:.1f}s {diff or ''}", flush=True)
        if ok is False or n == 0:
            bad.append(name)
    print("@@ BAD:", bad)
