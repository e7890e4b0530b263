"""Runs registered queries beside their SQL and compares rows as unordered bags."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES: dict[str, float] = {}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    """Empty string when both sides agree."""
    began = time.time()
    frame = query(spark, folder)
    rows = frame.collect()
    TIMES[name] = time.time() - began
    got_columns, got = bag(frame.columns, rows)
    if sql is None:
        return "" if frame.columns else "no columns"
    cursor = con.execute(sql)
    want_columns, want = bag([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return "" if got else "EMPTY"
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 200_000 else []
    missing = [r for r in want if r not in set(got)][:3] if len(got) < 200_000 else []
    return f"{got_columns}: {len(got)} rows vs {len(want)}\n   spark only {extra}\n   sql only   {missing}"


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tessitura.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            message = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok" if not message else "FAIL"
        if message == "EMPTY":
            mark, message = "ok-empty", ""
        print(f"{name:32s} {mark:8s} spark {TIMES.get(name, 0):6.2f}s all {time.time() - began:6.2f}s {'' if name in oracles else '(rows only)'} {message}", flush=True)
        if mark == "FAIL":
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
