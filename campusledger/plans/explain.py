"""Print the physical plans of registered queries.

    python -m campusledger.plans.explain [sf_dir] [name ...]

AQE is switched off for printing so the static plan shape (exchanges, join
strategies, aggregation modes) is visible; at run time AQE may still
coalesce partitions, switch a join to broadcast or split skewed partitions.
"""

from __future__ import annotations

import sys

from campusledger.plans import QUERIES, load_all
from campusledger.session import get_session


def physical_plan(spark, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().treeString()


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    names = argv[2:] or sorted(QUERIES)
    spark = get_session("local[4]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for name in names:
        print(f"== {name} ==")
        print(physical_plan(spark, name, sf_dir))


if __name__ == "__main__":
    main(sys.argv)
