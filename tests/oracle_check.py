"""Run catalogue queries against their SQL twins: python tests/oracle_check.py <dir> [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from contactmill.plans.derived import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return "decimal " + str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir, entry):
    df = entry.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if entry.sql is None:
        return True, f"rows={len(got)} (no twin)"
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got == want:
        return True, f"rows={len(got)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return False, f"rows {len(got)} vs {len(want)}; first differences {diff}"


def main():
    from contactmill.session import local_session
    from contactmill.plans import load_all
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    entries = load_all()
    spark, con, bad = local_session("check"), connect(sf_dir), []
    for name, entry in entries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, entry)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.2f}s {note[:1500]}", flush=True)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
