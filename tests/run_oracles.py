"""Compare all or the named queries with their oracles: ``run_oracles.py [sf] [name ...]``."""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from rowtide.session import local_session  # noqa: E402
from tests import oracle  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(8), oracle.connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            difference = oracle.compare(queries[name](spark, sf_dir), con, sql[name]) if name in sql else (
                f"no oracle, {queries[name](spark, sf_dir).count()} rows"
            )
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += difference is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if difference is None else difference}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
