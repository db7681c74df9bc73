"""Runs a registered query next to its SQL counterpart and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (2, f"{value:.10g}")
    if isinstance(value, int):
        return (2, f"{float(value):.10g}")
    return (3, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = con.sql(sql)
    expected = result.fetchall()
    if sorted(df.columns) != sorted(result.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(result.columns)}"
    a, b = _rows(df.columns, got), _rows(result.columns, expected)
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"rows {len(a)} / {len(b)}; only here {only_a}; only expected {only_b}"


def types(df, result):
    return {c: (df.schema[c].dataType.simpleString(), str(t)) for c, t in zip(result.columns, result.types)}


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from noticework.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("oracle")
    con = connection(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, oracles[name], folder) if name in oracles else f"no SQL, {query(spark, folder).count()} rows"
        except Exception as error:  # report every query, not only the first failure
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
