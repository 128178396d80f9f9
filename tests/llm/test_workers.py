"""Operators on workers that have no copy of the package, without any configured folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
def alone(batches):
    for batch in batches:
        try:
            import corpuskit
        except ImportError:
            yield batch
assert spark.range(4).mapInArrow(alone, "id long").count() == 4, "the workers know the package"
from corpuskit.session import freeze, scratch_path
assert freeze(spark.range(3)).count() == 3
spark.range(3).write.parquet(scratch_path(spark, "x"))
from corpuskit.llm.queries import QUERIES
for name in sys.argv[1:]:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    (tmp_path / "conf").mkdir()
    names = ["op1_language_id", "op3_multiprobe_neighbours", "op9_lattice_lm", "op11_token_counts", "op12_conversation_repair", "op13_collocations"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    script = tmp_path / "script.py"
    script.write_text(SCRIPT.format(root=ROOT))
    run = subprocess.run([sys.executable, str(script), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[0] for line in run.stdout.splitlines() if line.startswith("op")] == names
