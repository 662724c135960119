"""Study plan: greedy choice of topics by priority within a budget of hours, laid out on days."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SLACK = 1e-9


CHOICE = "rank int, topic_id int, name string, syllabus_unit string, hours double, needs_notes boolean, priority double, chosen boolean"


def plan_choice(stats: DataFrame, days_left: int, hours_per_day: float) -> DataFrame:
    """(rank, topic_id, name, syllabus_unit, hours, needs_notes, priority, chosen) of every topic with a priority.

    Topics are taken by falling priority (to 9 decimals, ties by topic_id); one that no longer fits is skipped and costs nothing,
    which no running sum can express. So the topics, sorted by Spark, stream through one task that carries the hours left.
    """
    if days_left <= 0 or hours_per_day <= 0:
        raise ValueError("a plan needs a positive number of days and of hours a day")
    budget = float(days_left * hours_per_day)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, rank = budget, 0
        for b in batches:
            chosen = []
            for hours in b["hours"].to_pylist():
                chosen.append(hours <= left + _SLACK)
                left -= hours if chosen[-1] else 0.0
            ranks = pa.array(range(rank + 1, rank + 1 + b.num_rows), pa.int32())
            rank += b.num_rows
            yield pa.RecordBatch.from_arrays([ranks, *b.columns, pa.array(chosen, pa.bool_())], names=["rank", *b.schema.names, "chosen"])

    rows = stats.where("priority > 0").select(F.col("topic_id").cast("int").alias("topic_id"), "name", "syllabus_unit", F.col("effort_hours").cast("double").alias("hours"), (~F.col("has_notes")).alias("needs_notes"), F.col("priority").cast("double").alias("priority"))
    return rows.repartition(1).sortWithinPartitions((-F.round("priority", 9)), "topic_id").mapInArrow(choose, CHOICE)


def plan_blocks(choice: DataFrame, days_left: int, hours_per_day: float) -> DataFrame:
    """(day, topic_id, topic, syllabus_unit, hours, needs_notes, priority): chosen topics on days, spilling over.

    The running sum of the chosen hours gives each topic an interval; a day's block is its overlap with the day.
    """
    w = Window.partitionBy("chosen").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # as many rows as topics
    at = choice.where("chosen").withColumn("end", F.sum("hours").over(w)).withColumn("begin", F.col("end") - F.col("hours"))
    day = F.lit(float(hours_per_day))
    first, last = F.floor((F.col("begin") + _SLACK) / day).cast("int"), F.least(F.ceil((F.col("end") - _SLACK) / day).cast("int") - 1, F.lit(days_left - 1))
    laid = at.where(first <= last).withColumn("d", F.explode(F.sequence(first, last)))
    hours = F.least(F.col("end"), (F.col("d") + 1) * day) - F.greatest(F.col("begin"), F.col("d") * day)
    return laid.select((F.col("d") + 1).alias("day"), "topic_id", F.col("name").alias("topic"), "syllabus_unit", F.round(hours, 2).alias("hours"), "needs_notes", F.round("priority", 3).alias("priority")).where("hours > 0")


def plan_summary(choice: DataFrame, stats: DataFrame, days_left: int, hours_per_day: float) -> DataFrame:
    """Topics and hours planned, hours left, and the share of expected marks covered, in one row."""
    budget = float(days_left * hours_per_day)
    marks = stats.select("topic_id", "expected_marks").join(choice.where("chosen").select("topic_id", F.lit(True).alias("planned"), "hours", "needs_notes"), "topic_id", "left")
    total, used = F.sum("expected_marks"), F.coalesce(F.sum("hours"), F.lit(0.0))
    return marks.agg(
        F.count_if("planned").alias("topics_planned"), F.round(used, 2).alias("hours_planned"), F.round(F.lit(budget) - used, 2).alias("hours_unused"),
        F.when(total > 0, F.round(F.lit(100.0) * F.coalesce(F.sum(F.when(F.col("planned"), F.col("expected_marks"))), F.lit(0.0)) / total, 1)).otherwise(0.0).alias("expected_marks_covered_pct"),
        F.count_if(F.col("planned") & F.col("needs_notes")).alias("n_needing_notes"),
    )


def not_scheduled(choice: DataFrame) -> DataFrame:
    """Topics with a priority that the budget doesn't reach."""
    return choice.where(~F.col("chosen")).select("rank", "topic_id", "name")
