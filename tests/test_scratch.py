"""The shared folder of sessions without ``spark.checkpoint.dir``."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from fragloom.session import local_session
from fragloom.scratch import cut, shared_dir
spark = local_session("2", 2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
where = shared_dir(spark)
assert where == shared_dir(spark) and where.startswith("file:///")
rows = cut(spark.range(5), "five")
assert rows.count() == 5 and rows.inputFiles()[0].startswith(where)
spark.stop()
print("done")
"""


def test_a_local_session_without_the_setting_has_one_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
