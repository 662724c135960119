"""Coverage gaps: what exams ask against what the syllabus and the notes cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.statistics import by_topic_year, years_of
from lectern.params import DEFAULT, Params


def never_asked(stats: DataFrame) -> DataFrame:
    """Topics in no dated paper."""
    return stats.where("n_questions = 0").select("topic_id", "name", "syllabus_unit", "has_notes")


def out_of_syllabus(topics: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions without a topic or with one the syllabus lacks; of the report's columns those that exist."""
    columns = [c for c in ("id", "year", "marks", "text", "document_id", "page") if c in questions.columns]
    return questions.join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_anti").select(*columns)


def frequent_without_notes(stats: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Often asked topics that no note covers, most expected marks first."""
    hit = stats.where((F.col("year_share") >= params.frequent_year_share) & ~F.col("has_notes"))
    return hit.select("topic_id", "name", "syllabus_unit", "years_asked", "year_share", "expected_marks", "max_repeat_count").orderBy(F.desc("expected_marks"), "topic_id")


def topic_year_heatmap(topics: DataFrame, questions: DataFrame) -> DataFrame:
    """(topic_id, name, year, marks) for every syllabus topic and every exam year; 0 where nothing was asked."""
    per_year = by_topic_year(questions)
    grid = topics.select(F.col("id").alias("topic_id"), "name").crossJoin(F.broadcast(years_of(per_year)))  # years: at most 110 of a valid table
    return grid.join(per_year.select("topic_id", "year", "marks"), ["topic_id", "year"], "left").select("topic_id", "name", "year", F.coalesce("marks", F.lit(0)).cast("long").alias("marks"))


def data_quality(questions: DataFrame) -> DataFrame:
    """One row: questions, and how many lack a year, marks or a topic."""
    missing = lambda c: F.count_if(F.col(c).isNull()).alias(f"missing_{c}")
    return questions.agg(F.count("*").alias("n_questions"), missing("year"), missing("marks"), missing("topic_id"))


def coverage_summary(stats: DataFrame, topics: DataFrame, questions: DataFrame) -> DataFrame:
    """The six numbers of the coverage panel, in one row."""
    marks, noted = F.sum("expected_marks"), F.sum(F.when(F.col("has_notes"), F.col("expected_marks")).otherwise(0.0))
    of_stats = stats.agg(
        F.count("*").alias("n_topics"), F.count_if(F.col("n_questions") > 0).alias("n_topics_asked"), F.count_if("has_notes").alias("n_topics_with_notes"),
        F.when(marks > 0, F.round(F.lit(100.0) * noted / marks, 1)).otherwise(0.0).alias("expected_marks_covered_by_notes_pct"),
    )
    per_topic = questions.groupBy("topic_id").agg(F.count("*").alias("n"))
    known = topics.select(F.col("id").alias("topic_id"), F.lit(True).alias("known"))
    of_questions = per_topic.join(known, "topic_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_questions"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_out_of_syllabus"))
    return of_stats.crossJoin(F.broadcast(of_questions)).select("n_topics", "n_topics_asked", "n_topics_with_notes", "n_questions", "n_out_of_syllabus", "expected_marks_covered_by_notes_pct")
