"""python tests/check.py [sf] [name ...] - compare registered queries with their SQL."""

from __future__ import annotations

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle import connect, differences  # noqa: E402

from dugout.session import local_session  # noqa: E402


def main() -> None:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check", cores=int(__import__("os").environ.get("CHECK_CORES", 8)))
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problems = differences(df, con, sql[name])
                n = ""
            else:
                n, problems = f" rows={len(df.collect())} (no SQL)", []
        except Exception as e:  # noqa: BLE001
            problems, n = [f"{type(e).__name__}: {str(e)[:600]}"], ""
            if wanted:
                traceback.print_exc()
        spark.catalog.clearCache()
        took = time.time() - t
        if problems:
            failed += 1
            print(f"FAIL {name} {took:.1f}s: {problems}", flush=True)
        else:
            print(f"ok   {name} {took:.1f}s{n}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
