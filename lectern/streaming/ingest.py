"""Incremental runs over new files: pages are parsed and stored as they arrive, each document once.

A file stream hands every new page file to foreachBatch exactly once per checkpoint. A batch parses its documents, leaves
out those already stored, and writes its own partition by overwriting it, so a batch that is run again after a failure
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.mutations import not_yet_stored, upsert_notes
from lectern.operators.papers import parsed_questions

PAGES = "document_id INT, page_number INT, text STRING, source STRING"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet. A table that can't be read raises."""
    system, where = _files(spark, path)
    return spark.read.parquet(path) if system.exists(where) and len(system.listStatus(where)) else None


def ingest_papers(spark: SparkSession, incoming: str, table: str, checkpoint: str, format: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Parse new page files into ``table``, partitioned by batch. All pages of a document must arrive in one batch;
    a document that is stored already is skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        old = _stored(session, table)
        fresh = batch if old is None else not_yet_stored(batch, old.where(F.col("batch_id") != batch_id))
        rows = parsed_questions(fresh).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)

    writer = spark.readStream.schema(PAGES).format(format).load(incoming).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


NOTES = "document_id INT, page INT, lecture_date STRING, taken_at STRING, text STRING, latex STRING, confidence DOUBLE"


#: Versions of the notes table that are kept: the newest, and one that readers may still be at.
KEPT_VERSIONS = 2


def ingest_notes(spark: SparkSession, incoming: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert new note files by (document_id, page). Version n of the table is written beside version n-1; a
    batch that is run again writes the same version again. Older versions than the last KEPT_VERSIONS are deleted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        last = batch.groupBy("document_id", "page").agg(F.max_by(F.struct("lecture_date", "taken_at", "text", "latex", "confidence"), F.coalesce("taken_at", F.lit(""))).alias("n")).select("document_id", "page", "n.*")
        earlier = sorted(v for v in _versions(session, folder) if v < batch_id)
        base = session.read.parquet(f"{folder}/v={earlier[-1]}") if earlier else session.createDataFrame([], "document_id INT, page INT, lecture_date STRING, text STRING, latex STRING, confidence DOUBLE")
        upsert_notes(base.select("document_id", "page", "lecture_date", "text", "latex", "confidence"), last).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")
        for v in earlier[: 1 - KEPT_VERSIONS]:
            system, where = _files(session, f"{folder}/v={v}")
            system.delete(where, True)

    writer = spark.readStream.schema(NOTES).parquet(incoming).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions that were written to the end."""
    system, where = _files(spark, folder)
    if not system.exists(where):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in system.listStatus(where) if s.getPath().getName().startswith("v=")]
    return [int(p.getName()[2:]) for p in found if system.exists(hadoop(p, "_SUCCESS"))]


def current_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version written by ingest_notes."""
    return spark.read.parquet(f"{folder}/v={max(_versions(spark, folder))}")
