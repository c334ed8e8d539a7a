"""Run every registered query against its DuckDB oracle.

Usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.oracle import compare, duck_connection  # noqa: E402
from vitrine.session import get_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name not in sqls:
                print(f"{name:28s} rows-only {df.count()} rows")
                continue
            ok, msg = compare(df, con, sqls[name])
        except Exception as exc:  # report and continue
            ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} {time.time() - t0:6.2f}s {msg}")
    print(f"{bad} mismatches")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
