"""Check registered queries by name: python tests/check.py [folder] [names...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tests import oracle  # noqa: E402


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    runs, sqls = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in (argv[1:] or list(runs)):
        t = time.time()
        try:
            if name in sqls:
                out = oracle.compare(spark, runs[name], sqls[name], con, folder)
            else:
                n = len(runs[name](spark, folder).toPandas())
                out = "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            out = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(out)
        print(f"{'FAIL' if out else 'ok  '} {time.time() - t:6.2f}s {name} {out}", flush=True)
    print("failed:", bad)


main(sys.argv[1:])
