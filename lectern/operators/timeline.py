"""Lecture timeline: one row per lecture (document), dated by its earliest page, with its topics and units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.schemas import require


def lectures(notes: DataFrame) -> DataFrame:
    """(document_id, lecture_date, n_pages, n_dates, dates_found); dates compare as text, null dates don't count.

    Distinct dates are found by a first aggregation, so that no task collects the pages of a hot lecture.
    """
    require("timeline_notes", notes)
    per_date = notes.groupBy("document_id", "lecture_date").agg(F.count("*").alias("n"))
    dates = F.sort_array(F.collect_list("lecture_date"))
    return per_date.groupBy("document_id").agg(F.min("lecture_date").alias("lecture_date"), F.sum("n").alias("n_pages"), F.count("lecture_date").alias("n_dates"), F.array_join(dates, "|").alias("dates_found"))


def timeline(notes: DataFrame) -> DataFrame:
    """Dated lectures in order of date, then id."""
    return lectures(notes).where("lecture_date is not null").select("document_id", "lecture_date", "n_pages").orderBy("lecture_date", "document_id")


def unscheduled(notes: DataFrame) -> DataFrame:
    """Lectures without any date."""
    return lectures(notes).where("lecture_date is null").select("document_id", "n_pages")


def date_conflicts(notes: DataFrame) -> DataFrame:
    """Lectures whose pages have more than one date."""
    return lectures(notes).where("n_dates > 1").select("document_id", "lecture_date", "n_dates", "dates_found")


def lecture_topics(notes: DataFrame, note_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(document_id, topic_id, name, syllabus_unit): every topic tagged to a page; links to nothing are left out."""
    links = notes.select(F.col("id").alias("note_id"), "document_id").join(note_topics.select("note_id", "topic_id"), "note_id").select("document_id", "topic_id").distinct()
    return links.join(topics.select(F.col("id").alias("topic_id"), "name", "syllabus_unit"), "topic_id").select("document_id", "topic_id", "name", "syllabus_unit")


def lecture_units(tagged: DataFrame) -> DataFrame:
    """(document_id, syllabus_units): the sorted distinct units of a lecture, joined by '|'."""
    return tagged.select("document_id", "syllabus_unit").distinct().groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list("syllabus_unit")), "|").alias("syllabus_units"))


def timeline_quality(notes: DataFrame) -> DataFrame:
    """Numbers of lectures, undated ones and such with conflicting dates, in one row."""
    return lectures(notes).agg(F.count("*").alias("n_lectures"), F.count_if(F.col("lecture_date").isNull()).alias("n_unscheduled"), F.count_if(F.col("n_dates") > 1).alias("n_date_conflicts"))
