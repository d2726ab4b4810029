"""Compares queries with their DuckDB SQL: columns, row count, values. An empty result is a failure."""

import math
import os
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if not want:
        return "empty"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"rows {len(got)} / {len(want)}; only Spark {a}; only SQL {b}"[:900]
    return None


def main(names, sf_dir=os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from lexloom import registry
    from lexloom.session import get_spark

    spark = get_spark("oracle", cpus=4, shuffle_partitions=4)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    chosen = set()
    for n in names:
        if n in registry.MODULES:
            from importlib import import_module

            chosen |= set(import_module(f"lexloom.plans.{n}").QUERIES)
    for name, query in queries.items():
        if names and name not in chosen and name not in names:
            continue
        t = time.time()
        try:
            if name in oracles:
                found = compare(spark, con, name, query, oracles[name], sf_dir)
            else:
                found = None if query(spark, sf_dir).count() else "empty"
        except Exception as e:
            found = f"{type(e).__name__}: {e}"[:700]
        if found:
            bad += 1
            print("FAIL", name, found, flush=True)
        elif time.time() - t > 4:
            print("slow", name, round(time.time() - t, 1), flush=True)
    print("bad", bad, "of", len(queries))


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
