"""Run registered queries next to their SQL in DuckDB and compare rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_norm(r[i]) for i in at) for r in data), key=repr)


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def type_problems(df, description):
    """Columns whose type differs between the two engines."""
    want = {d[0]: str(d[1]) for d in description}
    return [
        f"{c}: {t} != {want[c]}" for c, t in df.dtypes if c in want and TYPES.get(t, t) != want[c]
    ]


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows(cols, res.fetchall())
    problems = type_problems(df, res.description)
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(cols)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        problems.append(f"only spark {sorted(a, key=repr)[:3]} only sql {sorted(b, key=repr)[:3]} of {len(a)}/{len(b)}")
    return len(got), problems


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from cuelake.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                n, problems = compare(spark, con, name, query, oracle[name], sf_dir)
            else:
                n, problems = query(spark, sf_dir).count(), []
            print(f"{'ok ' if not problems else 'BAD'} {name} rows={n} {time.time() - t:.2f}s {'' if name in oracle else '(rows only)'}", flush=True)
            for p in problems:
                print("    ", p[:900], flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"ERR {name}: {str(e)[:900]}", flush=True)


if __name__ == "__main__":
    main()
