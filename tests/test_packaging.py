"""The Python workers must find the package even when the driver runs elsewhere."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as e
assert e.entry(spark).count() > 0
assert e.queries()["generate_qa"](spark, "/root/testdata/sf0.001").count() > 0
print("PACKAGING-OK")
"""


def test_python_stages_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "PACKAGING-OK" in out.stdout, out.stderr[-2000:]
