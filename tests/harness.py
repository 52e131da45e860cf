"""Compare registered queries with their check SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def duck(sf_dir):
    from webrec.plans.inputs import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


KINDS = {"bigint": "int", "integer": "int", "int": "int", "hugeint": "HUGE", "string": "str", "varchar": "str",
         "double": "float", "float": "float", "boolean": "bool", "timestamp": "ts", "date": "date"}


def compare(df, con, sql):
    """None when equal, else a message."""
    cols = sorted(df.columns)
    kinds = {f.name: KINDS.get(f.dataType.simpleString().lower(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(sql)
    okinds = {c: KINDS.get(str(t).lower(), str(t)) for c, t in zip(rel.columns, rel.types)}
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}"
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    warn = {c: (kinds[c], okinds[c]) for c in cols if kinds[c] != okinds[c] and not kinds[c].startswith(("array", "map", "struct"))}
    if warn:
        return f"types {warn}"
    if got == want:
        return None
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"rows spark={len(got)} sql={len(want)} cols={cols}\n    only spark: {str(extra)[:900]}\n    only sql:   {str(missing)[:900]}"


def main(sf_dir, names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from webrec.session import build_session

    spark = build_session("harness", 8, 8)
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    picked = [n for n in qs if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = 0
    for n in picked:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in oracle:
                msg = compare(df, con, oracle[n])
                rows = ""
            else:
                rows, msg = f"rows={len(df.collect())} (no SQL)", None
        except Exception as e:  # noqa: BLE001
            msg, rows = "ERROR " + (str(e)[:1200] if not isinstance(e, (KeyError, TypeError, AttributeError, NameError)) else traceback.format_exc()[-1200:]), ""
        if msg:
            bad += 1
            print(f"FAIL {n} ({time.time()-t:.1f}s): {msg}")
        elif rows or time.time() - t > 3:
            print(f"ok   {n} ({time.time()-t:.1f}s) {rows}")
    print(f"{len(picked) - bad}/{len(picked)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
