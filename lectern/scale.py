"""Helpers that keep plans safe on large, skewed inputs and on clusters that lose executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 256
#: Fewer rows than this are no burden for one task, whatever their keys.
HOT_ROWS = 100_000

_WRITTEN: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder, as one machine runs all; any other master raises,
    since rows written to the disks of separate executors would be lost silently.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read that.

    Unlike a checkpoint of the plan, the table also cuts what the optimizer has inferred of the rows, which grows
    with each round of an iterative algorithm.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame | None = None) -> None:
    """Delete the tables that cut() wrote: those ``df`` reads, or all. Nothing that still needs them may run later."""
    paths = {p.removeprefix("file:").lstrip("/") for p in df.inputFiles()} if df is not None else None
    for entry in list(_WRITTEN):
        spark, path = entry
        if paths is not None and not any(path.removeprefix("file:").lstrip("/") in p for p in paths):
            continue
        _WRITTEN.remove(entry)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is the cluster's scratch space
            pass


atexit.register(release)


def hot_keys(df: DataFrame, key: str, total: int) -> list:
    """Keys holding at least 1/HOT_SHARE of ``total`` rows: at most HOT_SHARE values, whatever the input size."""
    if total < HOT_ROWS:
        return []
    return [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT_SHARE >= total).select(key).collect()]


def skew_safe_join(big: DataFrame, key: str, small: DataFrame, total: int) -> DataFrame:
    """Inner join of ``big``, of ``total`` rows, with ``small`` (unique in ``key``), where few keys may hold most of ``big``.

    Rows of hot keys meet their partner in a broadcast of at most HOT_SHARE rows; all others go through a
    shuffled join. ``big`` is read twice, so it should be cheap to read (a scan or a table from cut()).
    """
    hot = hot_keys(big, key, total)
    if not hot:
        return big.join(small, key)
    is_hot = F.col(key).isin(hot)
    return big.where(is_hot).join(F.broadcast(small.where(is_hot)), key).unionByName(big.where(~is_hot).join(small, key))


#: Bytes of a source a core has at least where rows aren't spread for the sake of the cores.
CORE_BYTES = 1 << 20


def all_cores(df: DataFrame) -> DataFrame:
    """The rows over all cores where they come from a small source with fewer splits than that; others as they are.

    For steps that cost far more CPU than their bytes cost a shuffle. A source of any size worth a cluster isn't moved,
    and rows that have been shuffled already are left to the adaptive plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    leaves = plan.optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))  # whole files, not the columns read
    if size >= cores * CORE_BYTES or plan.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Number of partitions so that each holds about ``per_part`` rows."""
    return max(least, -(-rows // per_part))


def dense_ids(df: DataFrame, keys: list[str], name: str, first: int = 1) -> DataFrame:
    """Distinct ``keys`` with consecutive numbers in their order, without a global window.

    Keys are range-partitioned and sorted; each partition numbers its own rows behind those of the partitions before,
    whose counts (one number a partition) go over the driver.
    """
    from pyspark.sql import Window

    ranged = cut(df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    offsets, at = [], first - 1
    for part, n in counts:
        offsets.append((part, at))
        at += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _base long")) if offsets else df.sparkSession.createDataFrame([], "_part int, _base long")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.join(base, "_part").withColumn(name, (F.col("_base") + number).cast("long")).select(*keys, name)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once a session, so that they need no installation.

    The archive is made on the driver and handed out by Spark itself; no executor reads a driver's folder.
    """
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lectern-")
    copy = shutil.copytree(root, Path(folder) / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder) / root.name), "zip", root_dir=copy.parent, base_dir=root.name))
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(sc.applicationId)
