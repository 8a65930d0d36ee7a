"""Timings of the headline queries: one JSON line on standard output.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Every query runs in full into a sink that discards rows; `queries` holds the second of
two runs, `first_run` the first.
"""

from __future__ import annotations

import json
import os
import time

import pyspark
from pyspark.sql import SparkSession, functions as F

from scanloom.plans.queries import QUERIES
from scanloom.sources.corpus import read_corpus

HEADLINE = (
    "risk_summary", "redact_documents", "scan_findings_raw", "scan_response", "src_inventory",
    "line_explode", "archive_admission", "executive_summary", "explain_queue", "explain_joined",
    "scan_diff", "stream_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("scanloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # the queries together generate more classes than the default cache holds
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Column calls otherwise look up their call site in Python each time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # the test tables are single row groups, which one task would read alone
        .config("scanloom.corpus.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    first, second = {}, {}
    for times in (first, second):
        for name in HEADLINE:
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - started, 3)
    megabytes = read_corpus(spark, sf_dir).agg(F.sum("size")).first()[0] / 1e6
    findings = QUERIES["scan_response"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline queries, second run, total", "value": round(sum(second.values()), 3),
        "unit": "sec", "queries": second, "sf": os.path.basename(sf_dir.rstrip("/")),
        "first_run": first, "cores": int(cpus), "spark": pyspark.__version__,
        "corpus_mb": round(megabytes, 1),
        "risk_summary_mb_per_s": round(megabytes / second["risk_summary"], 1),
        "risk_summary_findings_per_s": round(findings / second["risk_summary"]),
        "redact_documents_mb_per_s": round(megabytes / second["redact_documents"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
