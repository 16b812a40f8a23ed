"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle_check.py SF NAME...`` (no names: all)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    import math
    from decimal import Decimal

    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, int):
        return v if isinstance(v, bool) else int(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir, query, sql):
    began = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return f"rows {len(got)}, no SQL, {took:.1f} s"
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"FAIL columns {sorted(df.columns)} {sorted(want_columns)}"
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if a == b:
        return f"ok rows {len(a)}, {took:.1f} s"
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"FAIL rows {len(a)} and {len(b)}; ours {only_a}; SQL {only_b}"


def main(sf, names):
    import __spark_entry__ as entry
    from cairn.session import local_session

    sf_dir = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names or queries:
        try:
            said = compare(spark, con, n, sf_dir, queries[n], sql.get(n))
        except Exception as e:
            said = f"FAIL {type(e).__name__} {str(e)[:900]}"
        bad += said.startswith("FAIL")
        print(n, said, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
