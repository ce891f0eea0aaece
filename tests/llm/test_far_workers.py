"""Executors that do not have the package: queries run in a process of their own, started from an empty folder."""
import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from flowglass.session import build_session
spark = build_session("far", master="local[2]", shuffle_partitions=2)
spark.sparkContext.setLogLevel("OFF")
def there(_):
    try:
        import flowglass
        return [True]
    except ModuleNotFoundError:
        return [False]
assert not spark.sparkContext.parallelize([0], 1).mapPartitions(there).first()
for name in sys.argv[1:]:
    entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("done", name)
"""


def test_queries_run_without_the_package_on_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op5_decontamination", "op11_collocations", "op12_ball_tree_top_k", "op13_periodic_runs"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.split() == [x for n in names for x in ("done", n)], out.stderr[-3000:]
