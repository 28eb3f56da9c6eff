"""Time the headline queries and the bulk paths; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
Every figure is the better of two runs after a warm-up of the session, and every result is
computed in full (written to a sink that drops it, or to files where files are the point).
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logspark.operators import ingest, rules as rule_ops  # noqa: E402
from logspark.plans import QUERIES  # noqa: E402
from logspark.plans.alert_queries import rules_frame  # noqa: E402
from logspark.plans.ingest_queries import raw_lines  # noqa: E402
from logspark.session import local_session  # noqa: E402
from logspark.sources import logs as store  # noqa: E402
from logspark.sources.events import load_logs  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
HEADLINE = [
    "period_stats", "today_vs_yesterday", "module_stats", "hotspots", "exceptions_by_type", "exception_trend",
    "system_health", "health_trend", "monitor_overview", "heatmap_calls_by_hour", "heatmap_summary",
    "log_search", "log_page", "keyword_search_fuzzy", "cross_system_page", "trace_lookup",
    "admitted_logs", "trailing_counts", "failure_runs", "stateless_rule_hits", "batch_operation_hits",
    "continuous_request_hits", "fired_alerts", "masked_documents", "partition_manifest", "archive_stats",
]


def drop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(run, times: int = 2) -> float:
    spent = []
    for _ in range(times):
        begun = time.perf_counter()
        run()
        spent.append(time.perf_counter() - begun)
    return min(spent)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    work = tempfile.mkdtemp(prefix="logspark-bench-")
    drop(load_logs(spark, FOLDER).groupBy("module").count())
    seconds = {name: best(lambda: drop(QUERIES[name](spark, FOLDER))) for name in HEADLINE}

    logs = load_logs(spark, FOLDER)
    n = logs.count()
    lines = f"{work}/lines"
    raw_lines(spark, FOLDER).select("value").repartition(int(CPUS)).write.text(lines)
    rules = rules_frame(spark).filter("id = 1")

    bulk = {
        "ingest_to_table": lambda: store.write_logs(
            ingest.ingest(spark.read.text(lines), "2024-01-30 12:00:00").filter("is_valid"), f"{work}/table", "overwrite"
        ),
        "rule_evaluation": lambda: drop(rule_ops.stateless_hits(logs, rules)),
        "json_export": lambda: store.export_json(store.read_logs(spark, f"{work}/table"), f"{work}/json"),
        "sheet_export": lambda: store.export_sheets(store.read_logs(spark, f"{work}/table"), f"{work}/sheets"),
        "archive_write": lambda: store.write_archive(store.read_logs(spark, f"{work}/table"), f"{work}/archive", "overwrite"),
    }
    seconds.update({name: best(run) for name, run in bulk.items()})
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "rows_per_sec": {name: round(n / seconds[name]) for name in bulk},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
