"""Run registered queries against their SQL: ``python tests/check_queries.py sf_dir [name part…]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from plan_checks import plan_problems  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from orderflow.session import build_session  # noqa: E402


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("check")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            flags = plan_problems(df)
            if flags:
                print(f"plan {name}: {flags}", flush=True)
            if name in oracles:
                mid = time.time()
                problems = compare(name, df, con, oracles[name])
                n = ""
            else:
                n, problems, mid = f"{df.count()} rows only", [], time.time()
        except Exception as error:  # noqa: BLE001
            problems = [f"{name}: {str(error)[:1500]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
            n, mid = "", time.time()
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {n}", flush=True)
        for p in problems:
            print("   ", p[:2500], flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
