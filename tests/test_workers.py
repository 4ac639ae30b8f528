"""A session that was started elsewhere, without the repository on any worker's path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from litquarry.session import local_session
spark = local_session(2, "elsewhere")
found = [entry.queries()[name](spark, "/root/testdata/sf0.001").count() for name in {names!r}]
print("rows", found)
entry.queries()[{names!r}[0]](spark, "/root/testdata/sf0.001")
print("files", len(spark.sparkContext._python_includes))
spark.stop()
"""


def test_workers_import_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, names=["r6_dense_top_k"])
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [" in done.stdout and "rows [0]" not in done.stdout, done.stderr[-2000:]
    assert "files 1" in done.stdout
