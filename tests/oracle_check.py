"""Compare registered queries with their SQL in DuckDB.

Rows are compared as multisets, columns by name. Run as a script with name prefixes to look at a few:
`python tests/oracle_check.py x1 j4`.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SAME_KIND = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}
SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(con, df, sql: str | None, allow_empty: bool = False) -> str:
    """Empty when equal, else what differs."""
    ours = df.collect()
    if not ours and not allow_empty:
        return "no rows"
    if sql is None:
        return ""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    off = [
        f"{f.name}: {f.dataType.simpleString()} against {kinds[f.name]}"
        for f in df.schema.fields
        if SAME_KIND.get(f.dataType.simpleString()) not in (None, kinds[f.name])
    ]
    if off:
        return f"types {off}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a == b:
        return ""
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{len(ours)} rows against {len(theirs)}; {sorted(names)}; only here {only_a}; only there {only_b}"


def main(prefixes) -> int:
    from __spark_entry__ import oracle_sql, queries
    from placework.session import local_session

    spark, con = local_session(), duck(SF_DIR)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            said = compare(con, fn(spark, SF_DIR), oracles.get(name))
        except Exception as error:  # report and go on with the other queries
            said = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(said)
        kind = "sql" if name in oracles else "rows"
        print(f"{name:32} {kind:4} {time.time() - start:6.2f}s {'ok' if not said else 'DIFFERS ' + said[:900]}", flush=True)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
