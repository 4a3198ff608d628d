"""Run registered queries beside their check SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session(cores: int = 8):
    from foliospark.session import build_session

    spark = build_session(
        "compare", f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": "/tmp/foliospark-warehouse", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """(ok, rows, message) of one query against its check."""
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, len(got), "rows only"
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != want_cols:
        return False, len(got), f"columns {cols} / {want_cols}"
    if got == want:
        return True, len(got), "match"
    if len(got) != len(want):
        note = f"rows {len(got)} / {len(want)}"
    else:
        note = "values"
    extra = [r for r in got if r not in set(want)][:3] if len(want) < 200000 else []
    lack = [r for r in want if r not in set(got)][:3] if len(got) < 200000 else []
    return False, len(got), f"{note}\n   spark only {extra}\n   check only {lack}\n   types {[type(v).__name__ for v in (got or [()])[0]]} / {[type(v).__name__ for v in (want or [()])[0]]}"


def main(argv):
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            ok, n, note = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as exc:
            ok, n, note = False, -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {n:>8} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} failing, {len([n for n in names if n in oracles])} with check SQL")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(1, main(sys.argv[1:])))
