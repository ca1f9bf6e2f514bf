"""Workers that have no copy of the package: driver started in another folder, the path set on the driver only."""

import os
import subprocess
import sys

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from pairgrade.session import local_session
spark = local_session(2, shuffle_partitions=2, name="foreign")
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit():
        print(name, query(spark, {SF!r}).count())
"""


def test_queries_run_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(x.split() for x in done.stdout.splitlines() if x.startswith("op"))
    assert len(counts) >= 10 and all(int(n) > 0 for n in counts.values())
