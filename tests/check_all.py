"""All queries against their twins: python tests/check_all.py [sf folder] [names...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from oracle import connect, differences

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "12g")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con, sql = connect(sf), entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        df = run(spark, sf)
        if name in sql:
            found = differences(df, con, sql[name])
        else:
            found = [] if df.collect() else ["no rows"]
    except Exception as error:
        found = [f"{type(error).__name__}: {str(error)[:1500]}"]
    bad += bool(found)
    print(f"{'FAIL' if found else 'ok  '} {name:32s} {time.time() - start:6.2f}s {'' if name in sql else '(rows only)'}", flush=True)
    for line in found:
        print("     ", line, flush=True)
print("failures:", bad)
