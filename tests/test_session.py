"""The shared folder where no checkpoint folder is configured."""

import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
from palaver.session import checkpoint, shared_folder
spark = SparkSession.builder.master("{master}").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] and shared_folder(spark, "x", "own") == shared_folder(spark, "x", "own")
assert checkpoint(spark.range(5)).count() == 5
"""


def test_a_session_on_one_machine_gets_a_folder_of_its_own(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", CODE.replace("{master}", "local[2]")], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
