"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the given tables, BENCH_CPUS the local cores. Every query
is run once over whole tables, its full result is produced and dropped. A small query is
run first so that no figure holds the start of the JVM. Extra names may be given as
arguments.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans.catalog import QUERIES  # noqa: E402
from lectern.session import build_session  # noqa: E402

HEADLINE = [
    "feedback_current", "dwell_batch", "admin_stats", "admin_daily_activity",
    "admin_top_papers", "admin_user_engagement", "constraint_audit", "digest_payload",
    "article_parse", "ingest_new_papers", "classify_backlog", "search_vector",
    "reader_heatmap", "reader_topics", "reader_summary", "learned_interests",
    "alert_match", "collaborative_score", "behaviour_score", "content_score",
    "instant_recommendations", "daily_recommendations",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["admin_journal_dist"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        result = QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
