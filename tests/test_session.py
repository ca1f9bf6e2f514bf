"""Intermediate tables: where they lie and how they go."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import os, sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from pairgrade import session as S
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
df = S.materialize(spark.range(5))
assert df.count() == 5 and S.work_dir(spark) == sys.argv[1]
(top,) = os.listdir(sys.argv[1] + "/pairgrade")
assert top == spark.sparkContext.applicationId
assert S.drop_tables(spark) and not S.drop_tables(spark) and os.listdir(sys.argv[1] + "/pairgrade") == []
class Far:
    class conf:
        get = staticmethod(lambda k, d=None: None if k == "spark.checkpoint.dir" else "file:/home/warehouse")
    class sparkContext:
        master = "yarn"
try:
    S.work_dir(Far)
except ValueError as e:
    print("refused", "spark.checkpoint.dir" in str(e))
"""


def test_tables_lie_in_the_shared_folder_and_can_be_dropped(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "refused True" in done.stdout
