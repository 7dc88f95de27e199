"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def kinds(columns, rows):
    """Value kind per column: whole numbers and fractions are told apart."""
    out = {}
    for i, c in enumerate(columns):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out[c] = "/".join(sorted("str" if k == "UUID" else k for k in seen))
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    raw = [tuple(x) for x in df.collect()]
    got_cols, got = rows_of(df.columns, raw)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names, other = [d[0] for d in cur.description], cur.fetchall()
    want_cols, want = rows_of(names, other)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want), key=str)[:2]
        lacking = sorted(set(want) - set(got), key=str)[:2]
        return f"rows {len(got)} != {len(want)}; only ours {extra}; only sql {lacking}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if not bad:
        mine, theirs = kinds(df.columns, raw), kinds(names, other)
        diff = {c: (mine[c], theirs[c]) for c in mine if mine[c] != theirs[c]}
        return f"value kinds differ {diff}" if diff else "" if got else "no rows"
    return f"{len(bad)} of {len(got)} rows differ, first\n   {got_cols}\n   {bad[0][0]}\n   {bad[0][1]}"


def main(argv):
    import __spark_entry__ as entry
    from tapeline.session import build_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            message = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            message = f"{type(exc).__name__}: {str(exc)[:1500]}"
        flag = "ok " if not message else "BAD"
        failed += bool(message)
        print(f"{flag} {name} {time.time() - start:.1f}s {'' if name in oracle else '(no sql)'} {message}", flush=True)
    print("failed", failed, "registered", len(queries), "with sql", len(oracle))


if __name__ == "__main__":
    main(sys.argv[1:])
