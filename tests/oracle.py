"""Side-by-side check of registered queries against their SQL in an in-process DuckDB.

    python -m tests.oracle [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canon(row):
    return tuple(
        (0, "") if v is None or (isinstance(v, float) and math.isnan(v)) else (1, 0.0 if v == 0 and isinstance(v, float) else v)
        for v in row
    )


def _sorted_rows(rows):
    return sorted((_canon(r) for r in rows), key=lambda r: [(c[0], str(type(c[1])), c[1]) for c in r])


def compare(df, con, sql: str) -> str:
    """Empty text when rows, column names, types and values agree."""
    cols = sorted(df.columns)
    got = _sorted_rows(tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = _sorted_rows(tuple(r[i] for i in order) for r in rel.fetchall())
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    bad_types = {c: (spark_types[c], types[c]) for c in cols if spark_types[c] != types[c]}
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)} {bad_types or ''}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, first {diff[0]} {bad_types or ''}"
    return f"types {bad_types}" if bad_types else ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from panelcast.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                msg = compare(df, con, sqls[name])
                msg = f"FAIL {msg}" if msg else "ok"
            else:
                msg = f"rows {len(df.collect())} (no SQL)"
        except Exception as err:  # report and go on with the next query
            msg = f"FAIL {type(err).__name__}: {str(err)[:600]}"
        bad += msg.startswith("FAIL")
        print(f"{name:34s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
