"""Run registered queries beside their SQL in DuckDB and compare all rows.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__) if not isinstance(v, (int, float)) else "n", v if v is not None else 0)
                 for v in row)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, otherwise what differs first."""
    mine_cols, mine = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    their_cols, theirs = normal(names, rel.fetchall())
    if mine_cols != their_cols:
        return f"columns {set(mine_cols) ^ set(their_cols)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for c in range(len(mine_cols)):
        a = {type(r[c]).__name__ for r in mine if r[c] is not None}
        b = {type(r[c]).__name__ for r in theirs if r[c] is not None}
        if a != b:
            return f"type of {mine_cols[c]}: {a} vs {b}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(n, x, y) for n, x, y in zip(mine_cols, a, b) if x != y]
        return f"{len(bad)} rows differ, first: {diff[:4]} in {dict(list(zip(mine_cols, a))[:0])}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from tipoff.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if not problem else f"MISMATCH {problem}"
            else:
                problem, note = "", f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{name:36s} {time.time() - start:6.1f}s  {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
