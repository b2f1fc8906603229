"""Compare all (or the named) queries against their SQL: python tests/check_all.py [sf] [names…]"""

import sys
import time

sys.path.insert(0, ".")

from rolemill.session import build_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    from rolemill import catalog

    catalog.load()
    from rolemill.catalog.registry import ORACLES, QUERIES

    spark = build_session("check", 8, shuffle=8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            if name in ORACLES:
                verdict = difference(df, con, ORACLES[name])
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = "ERROR " + str(error)[:700]
        if verdict == "" and not con.execute(ORACLES[name]).fetchall():
            verdict = "BAD no rows"
        if verdict == "" and time.time() - begin > 4:
            print(f"slow {name} {time.time() - begin:.1f}s", flush=True)
        ok = verdict == "" or verdict.startswith("rows only")
        bad += not ok
        if not ok or len(wanted) or verdict:
            print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - begin:.1f}s {verdict}", flush=True)
    print(f"{len(QUERIES)} queries, {len(ORACLES)} with SQL, {bad} bad")


main()
