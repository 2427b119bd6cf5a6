"""Command line: compare queries with their SQL. `python tests/run_checks.py SF_DIR [name ...]`."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tests.compare import connect, difference  # noqa: E402

sf_dir, names = sys.argv[1], sys.argv[2:]
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
queries, oracles, con, bad = contract.queries(), contract.oracle_sql(), connect(sf_dir), 0
chosen = [n for n in queries if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
for name in chosen:
    started = time.time()
    try:
        df = queries[name](spark, sf_dir)
        outcome = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
    except Exception as error:  # noqa: BLE001
        outcome = "".join(traceback.format_exception_only(error))[:600]
        if names:
            traceback.print_exc(limit=-3)
    failed = outcome is not None and not outcome.startswith("rows only")
    bad += failed
    print(f"{'FAIL' if failed else 'ok  '} {time.time() - started:6.1f}s {name} {outcome or ''}", flush=True)
print(f"{len(chosen)} queries, {bad} differences")
