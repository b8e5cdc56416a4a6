"""Run registered queries beside their oracles: `python -m tests.compare [sf] [name…]`."""

from __future__ import annotations

import sys
import time

import duckdb

from parley.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def spark_session(cpus: int = 8):
    spark = build_session("parley-tests", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 5000 else []
        lack = [r for r in want if r not in set(got)][:2] if len(want) < 5000 else []
        return f"{len(got)} rows vs {len(want)}; extra {extra} lacking {lack}"
    for a, b in zip(got, want):
        if a != b:
            return f"\n  spark  {a!r}\n  oracle {b!r}"
    return None


def main(args: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    sf = args[0] if args and args[0].startswith("0") else "0.001"
    names = [a for a in args if not a.startswith("0")]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, oracles = spark_session(), duck(sf_dir), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, fn, oracles[name], sf_dir)
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.2f}s {note[:1800]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
