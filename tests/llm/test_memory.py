"""What a pipeline stage leaves of an executor's memory, on executors that aren't the driver."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

RUN = """
import os
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

sys.path.insert(0, sys.argv[1])
import corpus_pipeline as cp

conf = {"spark.master": "local-cluster[1,1,1000]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
        "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[3]}/shared", "spark.sql.warehouse.dir": f"{sys.argv[3]}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()


def measure(batches):
    for _ in batches:
        above = int(open(f"/proc/{os.getppid()}/stat").read().rpartition(")")[2].split()[1])  # the daemon's parent is the executor
        held = [int(x.split()[1]) for x in open(f"/proc/{above}/status") if x.startswith("RssAnon")]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["kb"])


held = lambda: spark.range(0, 1, 1, 1).mapInArrow(measure, "kb long").first()[0] // 1024
docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
spark.range(0, 100, 1, 1).selectExpr("repeat(cast(id AS string), 400000) AS t").groupBy().agg({"t": "collect_list"}).selectExpr("size(`collect_list(t)`)").collect()
before = held()
dict(cp.STAGES)[sys.argv[2]](spark, docs, "")
print("HELD", before, held())
"""


def test_a_stage_gives_back_the_heap_of_the_one_before(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors log below Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    root = str(Path(__file__).resolve().parents[2])
    env["PYTHONPATH"] = root + os.pathsep + env.get("PYTHONPATH", "")
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    out = subprocess.run([sys.executable, "-c", RUN, root, "substring dedup", str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x.split() for x in out.stdout.splitlines() if x.startswith("HELD")]
    assert said, out.stderr[-2000:]
    before, after = map(int, said[0][1:])
    assert after < before - 100, said  # MB


def test_every_stage_begins_by_giving_back(monkeypatch):
    import corpus_pipeline as cp

    begun = []
    monkeypatch.setattr(cp, "begin", lambda spark: begun.append(1) or 1 / 0)
    for _, stage in cp.STAGES[:4]:
        try:
            stage(None, None, "")
        except ZeroDivisionError:
            pass
    assert len(begun) == 4
