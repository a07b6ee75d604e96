"""Run registered queries against their SQL: python tests/run_check.py [sf_dir] [name ...]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                diff = compare.differences(df, con, oracles[name])
                text = "ok" if not diff else "DIFF " + "\n   ".join(diff)
            else:
                text = f"rows {df.count()} (no sql)"
                diff = []
        except Exception as exc:  # noqa: BLE001
            diff = [exc]
            text = "ERROR " + str(exc)[:1500]
        bad += bool(diff)
        in_sql = compare.timings.pop() if compare.timings else 0.0
        print(f"{name:28s} {time.time() - t0 - in_sql:6.2f}s  (sql {in_sql:.2f}s)  {text[:2500]}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
