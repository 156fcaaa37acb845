"""

1. The range-bucket order primitive against the one-partition window it
   replaces (forward fill and global position on the messy lineitem table),
   with the number of tasks that do the ordering work.
2. The Spark jobs of one full analysis (``analyze`` + its record).

Prints one JSON object.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time


def _timed(fn, runs=3):
    out = []
    for _ in range(runs):
        t = time.perf_counter()
        fn()
        out.append(time.perf_counter() - t)
    return round(statistics.median(out), 3)


def main(argv):
    sys.path.insert(0, ".")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    import tablelens as tl
    from checks import fixtures as fx
    from tablelens.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.1"
    spark = local_session(8)
    sc = spark.sparkContext
    m = fx.lineitem_messy(spark, sf)
    order = fx.MESSY_LINEITEM_ORDER
    m.count()

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    w_all = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain_ffill = m.withColumn("l_quantity", F.last("l_quantity", True).over(w_all))
    plain_index = m.withColumn("_idx", F.row_number().over(Window.orderBy(*order)) - 1)

    res = {"machine": {"cpus": os.cpu_count(), "python": platform.python_version(),
                       "spark": spark.version, "master": sc.master}, "sf": sf}
    res["forward_fill"] = {
        "buckets_sec": _timed(lambda: noop(tl.forward_fill(m, ["l_quantity"], order))),
        "one_partition_window_sec": _timed(lambda: noop(plain_ffill)),
    }
    go = tl.GlobalOrder.build(m, order)
    res["global_index"] = {
        "buckets_sec": _timed(lambda: noop(tl.GlobalOrder.build(m, order).global_index())),
        "one_partition_window_sec": _timed(lambda: noop(plain_index)),
        "ordering_tasks_buckets": go.n_buckets,
        "ordering_tasks_window": 1,
        "largest_bucket_rows": max(go.bucket_counts()),
        "rows": go.n_rows,
    }

    # jobs of one full analysis
    sc.setJobGroup("analysis", "one full analysis")
    t = time.perf_counter()
    a = tl.analyze(fx.orders_messy(spark, sf), ["o_orderkey", "_copy"])
    a.record("m", "m").collect()
    for c in a.charts:
        c.data.collect()
    secs = time.perf_counter() - t
    jobs = sc.statusTracker().getJobIdsForGroup("analysis")
    sc.setJobGroup("other", "other")
    res["full_analysis_orders"] = {"sec": round(secs, 3), "spark_jobs": len(jobs)}
    print(json.dumps(res))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
