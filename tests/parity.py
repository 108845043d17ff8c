"""Run registered queries against their SQL twins in DuckDB; usable as a script.

    python tests/parity.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return "NULL" if value is None else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        tuple(_plain(r[i]) for i in order) for r in records
    )


def compare(spark, con, name, build, sql, sf_dir):
    """None when equal, else a short description."""
    df = build(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    if not ours[1]:
        return "both empty"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} rows differ, e.g.\n   ours {bad[0][0]}\n   sql  {bad[0][1]}" if bad else None


def main() -> None:
    import __spark_entry__ as e
    from premia.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("parity", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = oracle(sf_dir)
    sqls, failed = e.oracle_sql(), []
    for name, build in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, build, sqls[name], sf_dir)
            else:
                n = len(build(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as err:  # report every query, then fail once
            problem = f"{type(err).__name__}: {str(err)[:500]}"
        note = "" if name in sqls else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} {time.time() - start:.2f}s"
              + (f": {problem}" if problem else ""), flush=True)
        failed += [name] if problem else []
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
