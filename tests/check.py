"""Compare registered queries with their check SQL: rows, columns, kinds of types, values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _kind(name: str) -> str:
    n = name.lower()
    if n in ("bigint", "long"):
        return "bigint"
    if n in ("int", "integer"):
        return "int"
    if n in ("string", "varchar"):
        return "string"
    return n.replace("timestamp_ntz", "timestamp")


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    left, right = dict(df.dtypes), dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(left) != sorted(right):
        return f"columns {sorted(left)} / {sorted(right)}"
    kinds = {c: (_kind(left[c]), _kind(right[c])) for c in left if _kind(left[c]) != _kind(right[c])}
    cols = sorted(left)
    a = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(map(_value, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    if a != b:
        sa, sb = set(a), set(b)
        only_a = sorted(sa - sb, key=repr)[:1]
        only_b = sorted(sb - sa, key=repr)[:1]
        return f"rows {len(a)} / {len(b)}; only spark {only_a}; only sql {only_b}"
    if kinds:
        return f"types {kinds}"
    if not a:
        return "no rows"
    return None


def main() -> None:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from auditlake.session import session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = session("local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, name, query, oracles[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as e:  # report and go on with the next query
            verdict = "ERROR " + str(e)[:900]
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
