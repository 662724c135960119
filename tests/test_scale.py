from __future__ import annotations

import subprocess
import sys
from types import SimpleNamespace

import pytest

from lectern import scale


def session(master, conf=None, context_dir=None):
    known = SimpleNamespace(isDefined=lambda: context_dir is not None, get=lambda: context_dir)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf), sparkContext=context)


def test_folder_of_intermediate_tables(monkeypatch):
    monkeypatch.setattr(scale, "_OWN", ["file:///own"])
    assert scale.shared_dir(session("yarn", "s3a://x/y/")) == "s3a://x/y"
    assert scale.shared_dir(session("yarn", None, "hdfs://h/c/1")) == "hdfs://h/c/1"
    assert scale.shared_dir(session("local[4]")) == "file:///own"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scale.shared_dir(session(master))


def test_release_deletes_only_what_a_table_reads(spark):
    a, b = scale.cut(spark.range(5).toDF("x")), scale.cut(spark.range(7).toDF("x"))
    scale.release(a)
    assert b.count() == 7 and not any(path in str(scale._WRITTEN) for path in a.inputFiles())
    with pytest.raises(Exception):  # noqa: B017
        a.count()
    scale.release(b)


CLUSTER = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.executor.memory", "900m").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate())
import __spark_entry__
from lectern.operators.linking import components
edges = spark.range(200).selectExpr("id as left", "if(id % 10 = 9, id, id + 1) as right")
print("ROWS", components(edges).count())
"""


def test_tables_are_shared_between_executors(tmp_path):
    import os
    from pathlib import Path

    import pyspark

    home, root = tmp_path / "home", Path(__file__).resolve().parents[1]
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(root), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    (tmp_path / "shared").mkdir()
    ran = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path / "shared")], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "ROWS 200" in ran.stdout, ran.stderr[-2000:]


def test_small_sources_use_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert scale.all_cores(small).rdd.getNumPartitions() == cores and scale.all_cores(small).count() == 1000
    large = spark.range(10_000_000).selectExpr("id", "repeat('x', 100) as t")
    assert scale.all_cores(large) is large
