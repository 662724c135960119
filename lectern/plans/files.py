"""Queries of readers, sinks and streams: tables are written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import editing
from lectern.functions.text import norm_words
from lectern.operators import exports, linking, pages, papers
from lectern.plans.papers import SQL as PAPER_SQL
from lectern.plans.papers import _pages
from lectern.plans.records import SQL as RECORD_SQL
from lectern.schemas import DDL, REQUIRED
from lectern.scale import shared_dir
from lectern.sources import pdf, readers, sinks
from lectern.sources.tables import table
from lectern.streaming.ingest import current_notes, ingest_notes, ingest_papers


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def q_syllabus(spark: SparkSession, d: str) -> DataFrame:
    """The syllabus as an upload has it: other headers, an extra column, blanks around values."""
    t, path = table(spark, d, "topics"), _folder(spark)
    sinks.csv_file(t.select(F.col("syllabus_unit").alias(" Module "), F.concat(F.lit(" "), "name", F.lit(" ")).alias("Topic-Name"), F.col("id").cast("string").alias("No"), F.col("topic_code").alias("CODE")), path)
    return readers.syllabus_csv(spark, path)


def q_json(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.json_lines(table(spark, d, "notes").select("id", "document_id", "page", "lecture_date", "text", "latex", "confidence"), path)
    return readers.json_records(spark, path, "id INT, document_id INT, page INT, lecture_date STRING, text STRING, latex STRING, confidence DOUBLE", lines=True)


def q_as_json(spark: SparkSession, d: str) -> DataFrame:
    return exports.as_json(table(spark, d, "questions").select("id", "document_id", "text", "section", "marks", "is_compulsory"))


def q_sidecars(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.sidecars(table(spark, d, "notes").select("document_id", F.col("page").alias("page_number"), F.col("id").alias("note_id"), "text", "confidence"), path)
    return readers.stored_sidecars(spark, path, "document_id INT, page_number INT, note_id INT, text STRING, confidence DOUBLE")


def q_page_counts(spark: SparkSession, d: str) -> DataFrame:
    return papers.page_counts(table(spark, d, "notes"))


def q_append(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of one table, the second of which repeats rows: an insert keeps both."""
    q, path = table(spark, d, "questions").select("id", "document_id", "text", "year"), _folder(spark)
    sinks.append(q, path, "year")
    sinks.append(q.where("year = 2020"), path, "year")
    return spark.read.schema("id INT, document_id INT, text STRING, year INT").parquet(path)


def q_by_year_table(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.questions_by_year(table(spark, d, "questions").select("id", "document_id", "page", "year"), path)
    return spark.read.schema("id INT, document_id INT, page INT, year INT").parquet(path)


def q_deck(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.anki_deck(exports.anki_rows_all(table(spark, d, "flashcards"), table(spark, d, "note_topics")), path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"').toDF("front", "back", "tags")


def q_pdf(spark: SparkSession, d: str) -> DataFrame:
    """The notes of each document as a PDF file, and the letters and figures that are read back from it."""
    path = _folder(spark)
    sinks.document_files(pdf.pdf_documents(exports.markdown_pages(table(spark, d, "notes"))), path)
    read = pdf.pdf_pages(readers.binary_files(spark, path, "*.pdf"))
    page = F.struct("page_number", F.regexp_replace("embedded_text", "[^A-Za-z0-9]", "").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"]), "")
    found = read.groupBy(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("int").alias("document_id")).agg(whole.alias("t"))
    return found.select("document_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def q_unassigned(spark: SparkSession, d: str) -> DataFrame:
    return linking.unassigned(table(spark, d, "questions")).select("id", "document_id")


def q_required(spark: SparkSession, d: str) -> DataFrame:
    """Which required columns the tables have."""
    rows = [(n, c, c in table(spark, d, n).columns) for n, cs in REQUIRED.items() if n in DDL for c in cs]
    return spark.createDataFrame(rows, "table_name string, column_name string, present boolean")


def q_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").where("text is not null and cleaned_text is not null").select("id", F.round(editing.match_ratio("text", "cleaned_text"), 6).alias("ratio"))


def q_char_errors(spark: SparkSession, d: str) -> DataFrame:
    """Character edits of the normalised texts, row by row."""
    text = lambda c: F.array_join(norm_words(F.col(c)), " ")
    return table(spark, d, "questions").where("text is not null and cleaned_text is not null").select("id", F.length(text("text")).alias("n_chars"), F.levenshtein(text("text"), text("cleaned_text")).alias("n_edits"))


def q_scaled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select("id", pages.scaled(F.col("confidence") * 100 + (F.col("id") % 7 - 3) * 20, 0.01).alias("confidence"))


def q_stream_papers(spark: SparkSession, d: str) -> DataFrame:
    """The pages of all papers, parsed by a stream that starts with them."""
    folder = _folder(spark)
    _pages(spark, d).select("document_id", F.col("page_number").cast("int").alias("page_number"), "text", "source").write.parquet(f"{folder}/in")
    ingest_papers(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def q_stream_notes(spark: SparkSession, d: str) -> DataFrame:
    """All notes, then every third again with another text, each an upsert of the stream; of pages delivered twice in a
    batch the latest by taken_at counts."""
    folder = _folder(spark)
    notes = table(spark, d, "notes").select("document_id", F.col("id").alias("page"), "lecture_date", F.lit(None).cast("string").alias("taken_at"), "text", "latex", "confidence")
    for load in (notes, notes.where("page % 3 = 0").withColumn("text", F.concat(F.lit("v2 "), "text"))):
        load.write.mode("append").parquet(f"{folder}/in")
        ingest_notes(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark").awaitTermination()
    return current_notes(spark, f"{folder}/out").select("document_id", "page", "lecture_date", "text", "latex", "confidence")


QUERIES = {
    "syllabus_csv": q_syllabus, "json_records": q_json, "as_json": q_as_json, "page_sidecars": q_sidecars, "page_counts": q_page_counts, "append_rows": q_append, "year_partitions": q_by_year_table, "anki_deck_csv": q_deck, "pdf_round_trip": q_pdf,
    "unassigned_questions": q_unassigned, "required_columns": q_required, "sequence_ratio": q_ratio, "char_edits": q_char_errors, "scaled_confidence": q_scaled, "stream_papers": q_stream_papers, "stream_notes": q_stream_notes,
}

_REQUIRED = " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{c}' IN (SELECT column_name FROM (DESCRIBE {n})) AS present" for n, cs in REQUIRED.items() if n in DDL for c in cs)
_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower({}), '^[\s\x{{a0}}]+', ''), '[\s\x{{a0}}]+$', ''), '[\s\x{{a0}}]+', ' ', 'g')"

SQL = {
    "syllabus_csv": "SELECT topic_code, trim(name) AS name, syllabus_unit FROM topics WHERE topic_code <> '' AND trim(name) <> '' AND syllabus_unit <> ''",
    "json_records": "SELECT id, document_id, page, lecture_date, text, latex, confidence FROM notes",
    "as_json": "SELECT CAST(to_json({'id': id, 'document_id': document_id, 'text': text, 'section': section, 'marks': marks, 'is_compulsory': is_compulsory}) AS VARCHAR) AS value FROM questions",
    "page_sidecars": "SELECT document_id, page AS page_number, id AS note_id, text, confidence FROM notes",
    "page_counts": "SELECT document_id, count(*) AS total_pages FROM notes GROUP BY 1",
    "append_rows": "SELECT id, document_id, text, year FROM questions UNION ALL SELECT id, document_id, text, year FROM questions WHERE year = 2020",
    "year_partitions": "SELECT id, document_id, page, year FROM questions",
    "anki_deck_csv": f"SELECT front, back, tags FROM ({RECORD_SQL['anki_rows_all']})",
    "pdf_round_trip": f"WITH m AS ({RECORD_SQL['markdown_notes']}), t AS (SELECT document_id, coalesce(string_agg(regexp_replace(markdown, '[^A-Za-z0-9]', '', 'g'), '' ORDER BY page, note_id), '') AS t FROM m WHERE document_id IS NOT NULL GROUP BY 1) SELECT document_id, length(t) AS n_chars, md5(t) AS digest FROM t",
    "unassigned_questions": "SELECT id, document_id FROM questions WHERE topic_id IS NULL",
    "required_columns": _REQUIRED,
    "char_edits": f"SELECT id, length({_NORM.format('text')}) AS n_chars, levenshtein({_NORM.format('text')}, {_NORM.format('cleaned_text')}) AS n_edits FROM questions WHERE cleaned_text IS NOT NULL",
    "scaled_confidence": "SELECT id, round(least(1.0, greatest(0.0, (confidence * 100 + (id % 7 - 3) * 20) * 0.01)), 4) AS confidence FROM notes",
    "stream_papers": PAPER_SQL["parse_papers"],
    "stream_notes": "SELECT document_id, id AS page, lecture_date, CASE WHEN id % 3 = 0 THEN 'v2 ' || text ELSE text END AS text, latex, confidence FROM notes",
}
