"""Command line form of the check: python tests/check.py SF_DIR [name ...]."""

import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

from compare import compare, connect  # noqa: E402

from tidemark.plans import load_all  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries = load_all()
    bad = 0
    for name, q in queries.items():
        if wanted and not any(name == w or q.build.__module__.endswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            n, verdict = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            n, verdict = -1, f"error: {type(e).__name__}: {str(e)[:600]}"
        if verdict not in ("ok", "rows only"):
            bad += 1
        print(f"{name:32s} {n:7d} rows {time.time() - begin:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
