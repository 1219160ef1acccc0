"""Run queries against their SQL twins: ``python tests/compare.py [sf dir] [names ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, f"{float(value):.9g}" if isinstance(value, float) else f"{float(value):.9g}")
    if hasattr(value, "as_tuple"):
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def _types(names, kinds):
    return dict(zip(names, kinds))


FAMILY = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "int", "integer": "int", "int128": "int",
    "int64": "int", "int32": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
    "timestamp_ntz": "time", "timestamp": "time", "timestamp with time zone": "time",
}


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {d[0]: str(d[1]).lower() for d in cursor.description}
    for f in df.schema.fields:
        here, there = FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()), kinds[f.name]
        if FAMILY.get(there, there) != here:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {there}"
    order = sorted(names)
    mine = sorted(tuple(_plain(r[c]) for c in order) for r in rows)
    at = {c: i for i, c in enumerate(names)}
    theirs = sorted(tuple(_plain(r[at[c]]) for c in order) for r in expected)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        first = [(c, x[1][:80], y[1][:80]) for c, x, y in zip(order, *wrong[0]) if x != y]
        return f"{len(wrong)} of {len(mine)} rows differ, first: {first}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tableprep.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), oracle_connection(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted and not any(name.startswith(w.rstrip("*")) for w in wanted if w.endswith("*")):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, name, query, sqls[name])
                verdict = "ok" if problem is None else f"DIFF {problem}"
            else:
                verdict, problem = f"rows {query(spark, sf_dir).count()}", None
        except Exception as error:  # noqa: BLE001
            verdict = problem = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
