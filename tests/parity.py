"""Compare registered queries with their SQL twins in DuckDB: ``python tests/parity.py [names]``."""
from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> list[str]:
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        return [f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"]
    si = [spark_cols.index(c) for c in sorted(spark_cols)]
    di = [duck_cols.index(c) for c in sorted(duck_cols)]
    left = [tuple(cell(r[i]) for i in si) for r in spark_rows]
    right = [tuple(cell(r[i]) for i in di) for r in duck_rows]
    for n, c in enumerate(sorted(spark_cols)):
        a = {kind(r[n]) for r in left if r[n] is not None}
        b = {kind(r[n]) for r in right if r[n] is not None}
        if a != b:
            problems.append(f"type of {c}: {a} != {b}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    only_left, only_right = Counter(left) - Counter(right), Counter(right) - Counter(left)
    if only_left or only_right:
        problems.append(f"{sum(only_left.values())} rows differ, e.g. "
                        f"{list(only_left)[:3]} vs {list(only_right)[:3]}")
    return problems


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
              "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def type_gaps(df, con, sql) -> list[str]:
    """Declared column types that do not correspond."""
    left = dict(df.dtypes)
    right = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{c}: {left.get(c)} vs {right.get(c)}" for c in left
            if DUCK_TYPES.get(right.get(c)) != left[c]]


def main() -> int:
    import __spark_entry__ as entry
    from factmark.session import local_session
    sf_dir = "/root/testdata/sf0.01"
    names = sys.argv[1:] or list(entry.queries())
    spark, con, failed = local_session("8"), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            rows = df.collect()
            took = time.time() - start
            problems, note = [], "no oracle"
            if name in entry.oracle_sql():
                mark = time.time()
                cursor = con.execute(entry.oracle_sql()[name])
                problems = compare(rows, df.columns, cursor.fetchall(),
                                   [d[0] for d in cursor.description])
                problems += type_gaps(df, con, entry.oracle_sql()[name])
                note = f"duckdb {time.time() - mark:.1f}s"
        except Exception as exc:  # noqa: BLE001
            problems, took, note, rows = [str(exc)[:1500]], time.time() - start, "", []
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name}: {len(rows)} rows, {took:.1f}s {note}",
              flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
