"""Run every registered query against its DuckDB statement: check_all.py SOURCE_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences, type_differences  # noqa: E402
from haulcast.session import local_session  # noqa: E402


def main(source_dir: str, *only: str) -> int:
    spark = local_session("check", "8")
    con = connect(source_dir)
    statements, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = build(spark, source_dir)
            if name in statements:
                wrong, kind = differences(frame, con, statements[name]), "oracle"
                wrong = wrong or type_differences(frame, con, statements[name])
            else:
                wrong, kind = ([] if (n := frame.count()) else ["no rows"]), f"rows={n}"
        except Exception as error:  # noqa: BLE001
            wrong, kind = [f"{type(error).__name__}: {str(error)[:600]}"], "error"
        bad += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name} {kind} {time.time() - start:.1f}s", *wrong, sep="\n      ", flush=True)
    missing = statements.keys() - entry.queries().keys()
    print("failed", bad, "of", len(entry.queries()), "statements", len(statements), "unknown", sorted(missing))
    return bad


if __name__ == "__main__":
    raise SystemExit(main(*sys.argv[1:]))
