"""Compare queries with their SQL: python tests/verify.py SF_DIR [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import __spark_entry__ as entry
from millrace.session import local_session


def rounded(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(rounded(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, rounded(x)) for k, x in sorted(v.items()))
    return str(v)


def main(sf: str, names: list[str]) -> int:
    spark, db, bad = local_session(8), duckdb.connect(), 0
    db.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    for n in names or list(qs):
        t = time.time()
        try:
            df = qs[n](spark, sf)
            cols = sorted(df.columns)
            got = sorted(tuple(rounded(v) for v in r) for r in df.select(*cols).collect())
            if n not in sqls:
                print(f"rows  {n} {len(got)} {time.time() - t:.1f}s", flush=True)
                continue
            want_rel = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sqls[n]})").fetchall()
            want = sorted(tuple(rounded(v) for v in r) for r in want_rel)
            ok = got == want
            bad += not ok
            print(f"{'ok   ' if ok else 'DIFF '} {n} {len(got)} {len(want)} {time.time() - t:.1f}s", flush=True)
            if not ok:
                g, w = set(got), set(want)
                print("   only spark:", [str(x)[:300] for x in list(g - w)[:2]], "\n   only sql:", [str(x)[:300] for x in list(w - g)[:2]])
        except Exception as e:
            bad += 1
            print(f"ERROR {n} {str(e)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
