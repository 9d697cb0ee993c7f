"""The entry module works from any folder, with executors that don't have the package on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_runs_from_elsewhere(tmp_path, sf):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from veyra.session import get_spark
import __spark_entry__ as e
spark = get_spark("elsewhere", cores=2, shuffle_partitions=2)
print("ROWS", e.queries()["p1_found"](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout and int(out.stdout.split("ROWS")[1]) > 0, out.stderr[-2000:]
