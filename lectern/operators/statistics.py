"""Per-topic statistics: frequency, expected marks, due score, effort, priority.

Questions are aggregated by (topic, year) before anything else, with map-side combine, so a hot topic costs no more than
any other and every later step works on topics x years rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.params import DEFAULT, Params
from lectern.schemas import require


def by_topic_year(questions: DataFrame) -> DataFrame:
    """(topic_id, year, n, marks) over dated questions; null marks count as a question of 0 marks."""
    return questions.where(F.col("year").isNotNull()).groupBy("topic_id", "year").agg(F.count("*").alias("n"), F.coalesce(F.sum("marks"), F.lit(0)).alias("marks"))


def years_of(per_year: DataFrame) -> DataFrame:
    """All exam years, also those with out-of-syllabus questions only."""
    return per_year.select("year").distinct()


def recency_weight(age: Column, params: Params) -> Column:
    """0.5 ** (age / half life), or 1 without a half life."""
    return F.pow(F.lit(0.5), age / F.lit(float(params.recency_half_life_years))) if params.recency_half_life_years else F.lit(1.0)


def largest_repeats(questions: DataFrame) -> DataFrame:
    """(topic_id, largest): size of the largest repeat group of each topic, over dated questions."""
    grouped = questions.where(F.col("year").isNotNull() & F.col("repeat_group_id").isNotNull() & F.col("topic_id").isNotNull())
    return grouped.groupBy("topic_id", "repeat_group_id").agg(F.count("*").alias("n")).groupBy("topic_id").agg(F.max("n").alias("largest"))


def notes_per_topic(note_topics: DataFrame) -> DataFrame:
    """(topic_id, n_notes): distinct (note, topic) links; the note need not exist."""
    return note_topics.where(F.col("topic_id").isNotNull()).select("note_id", "topic_id").distinct().groupBy("topic_id").agg(F.count("*").alias("n_notes"))


def legacy_note_topics(notes: DataFrame, column: str = "topic_ids") -> DataFrame:
    """(note_id, topic_id) from a column that holds ids as a JSON array, a comma-separated list, or a number."""
    text = F.trim(F.col(column).cast("string"))
    items = F.split(F.regexp_replace(text, r"^\[|\]$", ""), ",")
    ids = F.filter(F.transform(items, lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return notes.select(F.col("id").alias("note_id"), F.explode(ids).alias("topic_id"))


def topic_stats(topics: DataFrame, questions: DataFrame, note_topics: DataFrame | None = None, params: Params = DEFAULT, ref_year: int | None = None) -> DataFrame:
    """One row per syllabus topic.

    ``ref_year`` is the year of the coming exam; null or 0 means the latest year + 1. Questions without a year are left
    out, without marks count 0 marks. Topics never asked have a null last year and a due score of 0. The plan fails at
    run time when no question has a year. Null topic ids and ids outside the syllabus count only towards the years.
    """
    require("topics", topics)
    require("questions", questions)
    per_year = by_topic_year(questions)
    scalars = years_of(per_year).agg(F.count("*").alias("n_years"), F.max("year").alias("last")).select(
        "n_years",
        F.coalesce(F.nullif(F.lit(ref_year).cast("int"), F.lit(0)), F.col("last") + 1).alias("ref"),
    )
    weighted = years_of(per_year).crossJoin(F.broadcast(scalars)).select("year", "ref", recency_weight(F.col("ref") - 1 - F.col("year"), params).alias("w"), "n_years")
    none = F.raise_error(F.lit("statistics need at least one question with a year")).cast("long")
    totals = weighted.agg(F.sum("w").alias("sum_w"), F.max("ref").alias("ref"), F.when(F.count("*") > 0, F.max("n_years")).otherwise(none).alias("n_years"))
    asked = (
        per_year.where(F.col("topic_id").isNotNull()).join(weighted.select("year", "w"), "year").groupBy("topic_id")
        .agg(F.sum("n").alias("n_questions"), F.count("*").alias("years_asked"), F.sum("marks").alias("total_marks"), F.sum(F.col("w") * F.col("marks")).alias("weighted"), F.max("year").alias("last_asked_year"))
    )
    repeats = largest_repeats(questions) if "repeat_group_id" in questions.columns else None
    base = F.col("effort_hours").cast("double") if "effort_hours" in topics.columns else F.lit(params.base_effort_hours)
    out = topics.select(F.col("id").alias("topic_id"), "name", "syllabus_unit", base.alias("base_effort")).join(asked, "topic_id", "left")
    out = out.join(repeats, "topic_id", "left") if repeats is not None else out.withColumn("largest", F.lit(None).cast("long"))
    out = out.join(notes_per_topic(note_topics), "topic_id", "left") if note_topics is not None else out.withColumn("n_notes", F.lit(0).cast("long"))
    out = out.crossJoin(F.broadcast(totals))

    n, years, last = F.coalesce("n_questions", F.lit(0)), F.coalesce("years_asked", F.lit(0)), F.col("last_asked_year")
    ratio = (F.col("ref") - last) / (F.col("n_years") / F.nullif(years, F.lit(0)))
    due = F.when(ratio.isNotNull(), F.least(ratio, F.lit(params.due_cap)) / F.lit(params.due_cap)).otherwise(0.0)
    has_notes = F.coalesce("n_notes", F.lit(0)) > 0
    out = out.select(
        "topic_id", "name", "syllabus_unit", n.cast("long").alias("n_questions"), years.cast("long").alias("years_asked"), (years / F.col("n_years")).alias("year_share"),
        F.coalesce("total_marks", F.lit(0)).cast("long").alias("total_marks"), (F.coalesce("weighted", F.lit(0.0)) / F.col("sum_w")).alias("expected_marks"),
        last.cast("int").alias("last_asked_year"), (F.col("ref") - last).cast("int").alias("years_since_last"), due.alias("due_score"),
        F.coalesce("largest", F.when(n > 0, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("max_repeat_count"), F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"), has_notes.alias("has_notes"),
        (F.col("base_effort") * F.when(has_notes, 1.0).otherwise(params.no_notes_penalty)).alias("effort_hours"),
    )
    per_hour = F.col("expected_marks") / F.col("effort_hours")
    return out.withColumns({"marks_per_hour": per_hour, "priority": per_hour * (F.lit(1.0) + F.lit(params.due_weight) * F.col("due_score"))})
