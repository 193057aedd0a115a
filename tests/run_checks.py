"""python tests/run_checks.py [sf] [name part ...]: compare queries and time them."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__ as entry
from compare import difference

from scrubline.session import local_session

if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    parts = sys.argv[2:]
    spark = local_session(8)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                message = difference(spark, sf, run, sql[name])
            else:
                message = None
                rows = run(spark, sf).count()
                print(f"     {name}: {rows} rows, no SQL")
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:600]}"
        bad += message is not None
        print(f"{'BAD ' if message else 'ok  '} {name} {time.time() - start:.1f}s {(message or '')[:900]}", flush=True)
    print("bad:", bad)
