"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to compile and then timed (the better of two runs); rows go to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from logweir.queries import QUERIES, engine

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: Text queries beside registered ones: the shapes that published log-analytics figures use.
TEXT = {
    "filtered_aggregate": 'from events | where event_type="error" | stats count',
    "full_scan_aggregate": "from lineitem | stats count, sum(l_extendedprice) as s by l_returnflag, l_linestatus",
    "full_text_search": 'from documents | rename text as _raw | search "apache license" | stats count',
    "range_filter_top": "from lineitem | where l_quantity >= 40 | top 10 l_suppkey",
    "time_bucketed": "from lineitem | timechart span=1d count",
    "join_aggregate": "from lineitem | rename l_orderkey as o_orderkey | join o_orderkey [from orders | fields o_orderkey, o_orderpriority] | stats count, sum(l_extendedprice) as s by o_orderpriority",
    "percentiles": "from lineitem | stats p50(l_extendedprice) as p50, p99(l_extendedprice) as p99 by l_returnflag",
    "sort_head": "from lineitem | sort -l_extendedprice | head 10",
    "regex_filter": 'from part | where p_name =~ "[a-z]+1[0-9]*" | stats count by p_brand',
}
REGISTERED = ["flagship", "eventstats", "streamstats_window", "sessionize", "chart_pivot", "rollup_multires", "outliers_mad", "parse_combined"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e = engine(spark, SF)
    runs = {n: (lambda q=q: e.query(q)) for n, q in TEXT.items()} | {n: (lambda n=n: QUERIES[n](spark, SF)) for n in REGISTERED}
    took = {}
    for name, make in runs.items():
        best = float("inf")
        for i in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start) if i else best
        took[name] = round(best, 4)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rpartition("sf")[2], "lineitem_rows_per_second_full_scan": round(rows / took["full_scan_aggregate"])}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
