"""Schemas of the domain tables, checks of required columns, and the validation rules of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



DDL = {
    "documents": "id INT, doc_type STRING, file_name STRING, file_path STRING, source_pages INT, taken_at STRING, year INT, exam_type STRING, created_at TIMESTAMP_NTZ",
    "topics": "id INT, topic_code STRING, name STRING, syllabus_unit STRING",
    "questions": "id INT, question_id STRING, document_id INT, page INT, text STRING, year INT, exam_type STRING, section STRING, marks INT, is_compulsory BOOLEAN, cleaned_text STRING, topic_id INT, repeat_group_id INT, created_at TIMESTAMP_NTZ",
    "notes": "id INT, document_id INT, page INT, lecture_date STRING, text STRING, structured_content STRING, latex STRING, confidence DOUBLE, created_at TIMESTAMP_NTZ",
    "note_topics": "note_id INT, topic_id INT, confidence DOUBLE",
    "flashcards": "id INT, note_id INT, front STRING, back STRING, linked_question_id INT",
    "pages": "document_id INT, page_number INT, doc_type STRING, image_path STRING, embedded_text STRING, taken_at STRING",
    "regions": "region_id STRING, region_type STRING, x INT, y INT, width INT, height INT, crop_path STRING",
    "ocr_words": "document_id INT, page_number INT, region_id STRING, word_id STRING, text STRING, confidence DOUBLE, x INT, y INT, w INT, h INT, line_id INT, corrected BOOLEAN",
    "ocr_equations": "document_id INT, page_number INT, region_id STRING, latex STRING, confidence DOUBLE, render_ok BOOLEAN, corrected BOOLEAN, x INT, y INT",
}

REQUIRED = {
    "topics": ("id", "name", "syllabus_unit"),
    "questions": ("id", "year", "marks", "text", "topic_id"),
    "notes": ("id", "lecture_date"),
    "note_topics": ("note_id", "topic_id"),
    "timeline_notes": ("id", "document_id", "lecture_date"),
}


def require(name: str, df: DataFrame) -> DataFrame:
    """The table itself, or a ValueError that names the table and the columns it lacks."""
    missing = sorted(set(REQUIRED[name]) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def valid_question(text: str = "text") -> Column:
    """What a stored question must be: page from 1, marks null or 1..100, year null or 1990..2099, text not blank."""
    page = F.coalesce(F.col("page") >= 1, F.lit(False))
    marks = F.col("marks").isNull() | F.col("marks").between(1, 100)
    year = F.col("year").isNull() | F.col("year").between(1990, 2099)
    return page & marks & year & F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions that keep the validation rules; the filter reaches the scan."""
    return questions.where(valid_question())


def rejected_questions(questions: DataFrame) -> DataFrame:
    """The other questions, as a side output instead of a log line."""
    return questions.where(~valid_question())
