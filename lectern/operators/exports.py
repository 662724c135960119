"""Lookups, flashcards, and exports as rows: a sink writes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def question_query(questions: DataFrame, document_id: int | None = None, year: int | None = None, section: str | None = None) -> DataFrame:
    """Questions of a document, else of a year, else all; the section compares trimmed, without case. The order is that
    of the lookup: page and id, id, or year descending (nulls last), document and id."""
    if document_id is not None:
        out, order = questions.where(F.col("document_id") == document_id), [F.asc_nulls_first("page"), F.asc("id")]
    elif year is not None:
        out, order = questions.where(F.col("year") == year), [F.asc("id")]
    else:
        out, order = questions, [F.desc_nulls_last("year"), F.asc("document_id"), F.asc("id")]
    if section:
        out = out.where(F.upper(F.coalesce("section", F.lit(""))) == section.strip().upper())
    return out.orderBy(*order)


def documents_newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("id"))


def document_by_id(documents: DataFrame, document_id: int) -> DataFrame:
    return documents.where(F.col("id") == document_id)


def topics_by_code(topics: DataFrame) -> DataFrame:
    return topics.orderBy("topic_code")


def pages_with_documents(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The contract between stages: each page with the attributes of its document."""
    d = documents.select(F.col("id").alias("document_id"), "doc_type", "taken_at")
    return pages.join(d, "document_id")


def upload_order(images: DataFrame) -> DataFrame:
    """(document_id, page_number, file_name): images in order of their time (none first), then name."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy(F.coalesce("taken_at", F.lit("")), "file_name")
    return images.select("document_id", F.row_number().over(w).alias("page_number"), "file_name")


def first_time(images: DataFrame) -> DataFrame:
    """(document_id, taken_at): the first time present, in order of upload."""
    return images.where("taken_at <> ''").groupBy("document_id").agg(F.min_by("taken_at", "upload_pos").alias("taken_at"))


def notes_to_structure(notes: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Notes with a text and no structured content, of the given ids; an empty list asks for none."""
    out = notes.where("text is not null and structured_content is null")
    return out if ids is None else out.where(F.col("id").isin(ids)) if ids else out.where("false")


def flashcards(notes: DataFrame, note_topics: DataFrame, questions: DataFrame) -> DataFrame:
    """(note_id, front, back, linked_question_id): a card per note with a text.

    The note's first topic (smallest id) gives the first repeated question of that topic (smallest id) as context. The
    lookups are two aggregations, so that no note asks for itself.
    """
    topic = note_topics.where("topic_id is not null").groupBy("note_id").agg(F.min("topic_id").alias("topic_id"))
    asked = questions.where("repeat_group_id is not null and topic_id is not null").groupBy("topic_id").agg(F.min(F.struct("id", "text")).alias("q")).select("topic_id", F.col("q.id").alias("qid"), F.col("q.text").alias("qtext"))
    cards = notes.where("text is not null").select(F.col("id").alias("note_id"), "page", "text").join(topic, "note_id", "left").join(asked, "topic_id", "left")
    lines = F.array_join(F.slice(F.split("text", "\n", -1), 1, 2), " ")
    back = F.when(F.col("qid").isNotNull(), F.concat(lines, F.lit("\n\n[Past Exam Context]: "), "qtext")).otherwise(lines)
    return cards.select("note_id", F.concat(F.lit("Key concept from page "), F.col("page").cast("string")).alias("front"), back.alias("back"), F.col("qid").alias("linked_question_id"))


def markdown_pages(notes: DataFrame) -> DataFrame:
    """(document_id, page, note_id, markdown): the part of a document's export that each note makes; a sink joins them
    by page and id behind one title."""
    date = F.when(F.col("lecture_date") != "", F.concat(F.lit("**Lecture Date:** "), "lecture_date", F.lit("\n\n"))).otherwise("")
    text = F.when(F.col("text") != "", F.concat("text", F.lit("\n\n"))).otherwise("")
    latex = F.when(F.col("latex") != "", F.concat(F.lit("**Equations:**\n$$\n"), "latex", F.lit("\n$$\n\n"))).otherwise("")
    return notes.select("document_id", "page", F.col("id").alias("note_id"), F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n"), date, text, latex, F.lit("---\n\n")).alias("markdown"))


def anki_rows(cards: DataFrame, notes: DataFrame, questions: DataFrame, tags: str = "StudyPlanner") -> DataFrame:
    """(flashcard_id, front, back, tags) of a document's cards: the linked question's text or the page, the note's text."""
    n = notes.select(F.col("id").alias("note_id"), "page", "text", "latex")
    q = questions.select(F.col("id").alias("linked_question_id"), F.col("text").alias("question"))
    rows = cards.select(F.col("id").alias("flashcard_id"), "note_id", "linked_question_id").join(n, "note_id").join(q, "linked_question_id", "left")
    front = F.coalesce("question", F.concat(F.lit("Note Review (Page "), F.col("page").cast("string"), F.lit(")")))
    back = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("latex") != "", F.concat(F.lit(" [LaTeX: "), "latex", F.lit("]"))).otherwise(""))
    return rows.select("flashcard_id", front.alias("front"), back.alias("back"), F.lit(tags).alias("tags"))


def anki_rows_all(cards: DataFrame, note_topics: DataFrame, tag: str = "study_platform") -> DataFrame:
    """(flashcard_id, front, back, tags) of all cards: line ends as <br>, a tag per topic of the note."""
    topics = note_topics.where("topic_id is not null").select("note_id", "topic_id").distinct().groupBy("note_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("topic_id")), lambda t: F.concat(F.lit("topic_"), t.cast("string"))), " ").alias("t"))
    rows = cards.select(F.col("id").alias("flashcard_id"), "note_id", "front", "back").join(topics, "note_id", "left")
    return rows.select("flashcard_id", "front", F.replace("back", F.lit("\n"), F.lit("<br>")).alias("back"), F.concat_ws(" ", F.lit(tag), "t").alias("tags"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
