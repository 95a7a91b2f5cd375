"""Run a query and its SQL twin side by side and compare columns, types and values.

``python tests/oracle.py <sf dir> [key or prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f:.9g}")
    return (3, str(v))


def _plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=lambda r: [_key(v) for v in r])


def compare(df, con, sql: str) -> str:
    """An empty text when equal, else what differs; text starting with ``~`` is a float hair."""
    spark_cols = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    described = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    if sorted(spark_cols) != sorted(described):
        return f"columns {sorted(spark_cols)} vs {sorted(described)}"
    types = [f"{c}:{t}/{described[c]}" for c, t in spark_cols.items()
             if SPARK_TO_SQL.get(t, t.upper()) != described[c]]
    if types:
        return "types " + ", ".join(types)
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    if not ours:
        return "empty"
    hair = 0
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            if x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)):
                continue
            if isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                hair += 1
                continue
            return f"values {a} vs {b}"
    return f"~{hair} floats differ in the last digits" if hair else ""


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from orebook.session import local_session

    sf, wanted = argv[0], argv[1:]
    spark, con = local_session("8"), connect(sf)
    qs, sqls, bad = queries(), oracle_sql(), 0
    for key, fn in qs.items():
        if wanted and not any(key == w or (w.endswith("_") and key.startswith(w)) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            note = compare(df, con, sqls[key]) if key in sqls else f"rows only {df.count()}"
        except Exception as e:
            note = "ERROR " + str(e).replace("\n", " ")[:700]
        fine = note == "" or note.startswith("rows only")
        bad += not fine
        print(f"{'ok ' if fine else 'BAD'} {key} {time.time() - start:.1f}s {note[:900]}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
