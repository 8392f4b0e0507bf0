"""Check chosen (or all) registered queries against DuckDB: python tests/run_check.py [sf_dir] [key ...]"""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from cairn.session import local_session
from compare import compare, duck

import __spark_entry__ as e

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf)
    keys = [k for k in qs if not args or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in args)]
    bad = 0
    for k in keys:
        t = time.time()
        try:
            df = qs[k](spark, sf)
            if k in sqls:
                p = compare(df, con, sqls[k])
                state = "ok" if not p else "BAD " + "; ".join(p)
            else:
                rows = df.collect()
                state = f"rows {len(rows)} {rows[:2]}"
        except Exception as ex:
            state = "BAD " + type(ex).__name__ + " " + str(ex)[:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += state.startswith("BAD")
        print(f"{k:32s} {time.time()-t:6.2f}s {state}"[:1200], flush=True)
    print("bad", bad, "of", len(keys))
