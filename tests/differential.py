"""Compares queries with their DuckDB equivalents: column names, and rows apart from order."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings download_instruct quality chats messages battery_prompts mix_targets pack_specs".split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 4)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return float(value) if isinstance(value, int) else str(value)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the two agree, else what differs."""
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    if mine == theirs:
        return ""
    extra, lacking = mine - theirs, theirs - mine
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list(extra)[:2]}; only there {list(lacking)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from loomstone.session import session

    spark, sf = session(), sys.argv[1]
    con, oracles = connect(sf), entry.oracle_sql()
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        begun = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                said = compare(df, con, oracles[name]) or f"equal, {df.count()} rows"
            else:
                said = f"no SQL, {len(df.collect())} rows"
        except Exception as error:  # the report goes on
            said = f"FAILED {type(error).__name__}: {str(error)[:700]}"
        print(f"@@ {name}: {said[:900]} ({time.time() - begun:.1f} s)", flush=True)
