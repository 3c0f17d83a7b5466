"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Each query runs once as warm-up, then ``$BENCH_REPEAT`` times (default 3);
the best time counts. Every run executes the whole plan through the ``noop``
sink (nothing is collected to the driver). Prints one JSON line.

Set ``BENCH_ALL=1`` to time every registered query instead of the headline set,
and ``BENCH_EVENT_LOG_DIR`` to a scratch folder to keep Spark's event log
(stage and task times) for the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "case_totals", "certificate_totals", "monthly_cases_by_grade", "unread_counts",
    "student_case_summary", "student_counseling_summary", "student_medical_summary",
    "student_medical_summary_search", "latest_semester_per_student", "student_prefix_search",
    "case_search", "medical_search", "medical_records", "attachment_files", "attachment_lookup",
    "pending_referrals", "update_cases", "update_medical", "confirm_medical_referrals_counseling",
    "insert_medical_notifications", "import_students_summary", "deactivate_users",
]


def main() -> None:
    from campusledger.plans import QUERIES, load_all
    from campusledger.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    load_all()
    names = sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    conf = {"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": "64m"}
    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    if event_dir:      # stage and task times, read from the event log afterwards
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir})
    spark = get_session(f"local[{cpus}]", app_name="campusledger-bench",
                        shuffle_partitions=int(cpus) * 2, extra_conf=conf)
    spark.sparkContext.setLogLevel("ERROR")
    times, errors = {}, {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        try:
            run()
            times[name] = round(min(run() for _ in range(repeat)), 3)
        except Exception as exc:  # keep timing the others; report the failure
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total_best_of_%d" % repeat,
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "spark": spark.version,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
