"""UDF-backed queries run from a session started outside the repository: Python
workers cannot import the package there, so its functions must travel with the
closures."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(REPO, '__spark_entry__.py')!r})
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
n = E.entry(spark).count()
m = E.queries()["oof_fit"](spark, E.SMOKE_DIR).count()
print("ROWS", n, m)
spark.stop()
"""


def test_udf_queries_run_from_a_foreign_directory():
    cwd = tempfile.mkdtemp(prefix="sieve-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert r.returncode == 0, r.stderr[-3000:]
    line = [ln for ln in r.stdout.splitlines() if ln.startswith("ROWS")][0]
    n, m = map(int, line.split()[1:])
    assert n > 0 and m > 0
