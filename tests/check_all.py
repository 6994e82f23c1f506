"""Compare all (or the named) registered queries with their SQL: python tests/check_all.py [sf] [name …]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import connect, difference

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
sf_dir = f"/root/testdata/sf{sf}"
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "12g")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
names = sys.argv[2:] or list(queries)
bad = []
for name in names:
    t = time.time()
    try:
        df = queries[name](spark, sf_dir)
        if name in oracle:
            why = difference(df, con, oracle[name])
            n = con.execute(f"SELECT count(*) FROM ({oracle[name]}) z").fetchall()[0][0]
        else:
            n, why = df.count(), None
    except Exception as e:
        n, why = -1, (str(e).split("JVM stacktrace")[0][:900] if "-v" not in sys.argv else traceback.format_exc())
    flag = "ok " if why is None else "BAD"
    print(f"{flag} {name} rows={n} {'oracle' if name in oracle else 'rows-only'} {time.time() - t:.1f}s", flush=True)
    if why:
        bad.append(name)
        print("    " + why.replace("\n", "\n    "), flush=True)
print("missing:", sorted(set(oracle) - set(queries)), "bad:", bad)
