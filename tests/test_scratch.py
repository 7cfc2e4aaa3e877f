import os
import subprocess
import sys

#: A session of its own, which names no shared folder, with an empty configuration folder.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert spark.conf.get("spark.checkpoint.dir", None) is None
from quillspark.sources.scratch import scratch_root
import __spark_entry__ as e
assert scratch_root(spark) == scratch_root(spark)
for name in ("anchor_gate_pass", "stored_append"):
    print(name, len(e.queries()[name](spark, sys.argv[1]).collect()))
class Cluster:
    conf = spark.conf
    class sparkContext:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf
try:
    scratch_root(Cluster)
except ValueError as x:
    print("refused", x)
"""


def test_session_without_a_shared_folder(sf_dir, tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": here, "TMPDIR": str(tmp_path)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", SCRIPT, sf_dir], env=env, cwd=here, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "anchor_gate_pass" in done.stdout and "stored_append" in done.stdout and "refused set spark.checkpoint.dir" in done.stdout
