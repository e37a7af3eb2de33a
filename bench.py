"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is run once to a
sink that reads all columns and keeps nothing. ``load_comments`` and ``stored_features``
are the two derived tables that later queries read; they are timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from palaver import fixtures
from palaver.registry import QUERIES, stored_features, stored_scaled
from palaver.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "bench", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    runs = {
        "load_comments": lambda s, d: fixtures.comment_facts(s, d).limit(0),
        "load_lexicon": lambda s, d: fixtures.lexicon(s, d).limit(0),
        "stored_features": lambda s, d: stored_features(s, d).limit(0),
        "stored_scaled": lambda s, d: stored_scaled(s, d).limit(0),
        **QUERIES,
    }
    chosen = set(sys.argv[1:])
    seconds: dict[str, float] = {}
    for name, run in runs.items():
        if chosen and name not in chosen:
            continue
        started = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
