"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Every query is
run to its last row; tables that several queries share are built first and timed on their own.
The tables of sf0.01 beside that folder are run first: ``growth`` is the ratio of the times, understated where the first run also warms up.
"""

from __future__ import annotations

import json
import os
import time

from buyerscope.plans import catalog
from buyerscope.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALLER = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.01")
CPUS = os.environ.get("BENCH_CPUS", "8")
SHARED = {
    "store_customer_360": catalog.wide,
    "store_cleaned": catalog.cleaned,
    "store_explored": catalog.explored,
    "store_scores": catalog.score_table,
    "store_prepared": catalog.model_split,
}
HEADLINE = [
    "customer_360", "cleaning_audit", "clean_winsorize", "dedupe_first", "date_parse", "feat_core", "feat_rfm",
    "tier_crosstab", "describe", "corr_matrix", "histogram", "kde", "boxplot", "crosstab", "kfold",
    "binary_metrics", "roc_curve", "threshold_sweep", "f1_sweep", "cv_threshold", "weight_grid", "subset_search",
    "power_transform", "smote", "lr", "gbt", "stack",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = catalog.queries()

    def time_all(folder: str) -> dict[str, float]:
        seconds: dict[str, float] = {}

        def timed(name: str, run) -> None:
            start = time.perf_counter()
            run()
            seconds[name] = round(time.perf_counter() - start, 3)

        for name, build in SHARED.items():
            timed(name, lambda b=build: b(spark, folder).count())
        for name in HEADLINE:
            timed(name, lambda n=name: queries[n](spark, folder).write.format("noop").mode("overwrite").save())
        return seconds

    small = time_all(SMALLER) if os.path.isdir(SMALLER) and SMALLER != FOLDER.rstrip("/") else {}
    seconds = time_all(FOLDER)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "queries_smaller": small,
                "growth": {n: round(seconds[n] / max(t, 0.001), 2) for n, t in small.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
