"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the number of cores.
Each query is run to the end through the noop sink; the time is wall-clock, planning included, of
one run after a first one on the same plan.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from maskwright.plans import catalog

HEADLINE = [
    "label_totals_by_language",
    "redaction_volume",
    "b11_detect_spans",
    "b15_redacted_texts",
    "c2_document_credentials",
    "c_log_credentials",
    "d6_ticket_verdicts",
    "d8_numbered_findings",
    "e7_staff_mentions",
    "e7_directory_mentions",
    "f1_counters",
    "f6_direction_by_label",
    "f7_running_counters",
    "h3_outcomes",
    "h7_backlog",
    "i4_by_label",
    "i5_totals",
    "d4_matching_masks",
    "d5_mask_union",
    "b14_label_changes",
    "i10_regressions",
    "i12_compare_engines",
    "j4_daily_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = catalog.queries()
    seconds: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        for _ in range(2):
            begun = time.perf_counter()
            registry[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "count(*) AS n", "sum(length(text)) AS c"
    ).first()
    detect = seconds.get("redaction_volume")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cores": int(cpus),
                "documents": documents.n,
                "characters": documents.c,
                "detect_redact_documents_per_sec": detect and round(documents.n / detect),
                "detect_redact_characters_per_sec": detect and round(documents.c / detect),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
