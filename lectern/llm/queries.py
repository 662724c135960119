"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.formatting import collapsed, format_copies, parsed_imports, stored_questions
from lectern.llm.grouping import question_groups
from lectern.llm.markup import clean_fields, markup_found
from lectern.llm.mixing import documents_chosen, mixture, shares_reached
from lectern.llm.packing import container_summary, packed
from lectern.llm.reading import LEAST_WORDS, level_profile, reading_levels
from lectern.llm.scans import defects_found, repaired
from lectern.llm.similar import similar_groups, similar_pairs
from lectern.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "questions").select(F.col("id").alias("doc"), "text")
    return similar_pairs(texts, 0.7).select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "questions").select(F.col("id").alias("doc"), "text")
    return similar_groups(texts, 0.7).select(F.col("doc").cast("int").alias("question_id"), F.col("rep").cast("int").alias("same_words_id"), F.col("group_id").cast("int").alias("group_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return question_groups(table(spark, d, "question_matches"), table(spark, d, "questions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects_found(table(spark, d, "questions"), table(spark, d, "notes"), table(spark, d, "note_transcripts"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    found = repaired(table(spark, d, "questions"), table(spark, d, "notes"), table(spark, d, "note_transcripts"))
    return found.select("source_table", "record_id", "clean_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup_found(table(spark, d, "notes"))


def p6_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return clean_fields(table(spark, d, "notes"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return stored_questions(table(spark, d, "questions")).unionByName(parsed_imports(table(spark, d, "question_imports")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies(_records(spark, d))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(_records(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_summary(_packed(spark, d))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents_chosen(_mixture(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares_reached(_mixture(spark, d), table(spark, d, "mix_targets"))


def _levels(spark: SparkSession, d: str, only: str | None = None) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), only=only)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, "lang = 'en'").where(F.col("n_words") >= LEAST_WORDS).select("doc_id", "level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return level_profile(_levels(spark, d))


_P3 = """
WITH RECURSIVE e AS (
  SELECT left_id AS a, right_id AS b FROM question_matches WHERE score >= 0.7 AND left_id <> right_id
  UNION SELECT min(id) OVER (PARTITION BY repeat_group_id), id FROM questions WHERE repeat_group_id IS NOT NULL),
 n AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 r(start, node) AS (SELECT a, a FROM n UNION SELECT r.start, n.b FROM r JOIN n ON r.node = n.a)
SELECT min(node) AS group_id, start AS question_id FROM r GROUP BY start"""

_RECORDS = r"""
SELECT 'questions' AS source_table, CAST(id AS BIGINT) AS id, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS bare, CAST(marks AS DOUBLE) AS marks FROM questions
UNION ALL SELECT 'question_imports', import_id, lower(regexp_replace(coalesce(payload ->> '$.raw_text', ''), '[^\p{L}\p{N}]', '', 'g')), try_cast(payload ->> '$.marks' AS DOUBLE) FROM question_imports WHERE json_valid(payload)"""

_QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p6_found": p6_found, "p6_clean_text": p6_clean_text, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_documents": p9_documents, "p9_shares": p9_shares, "p10_found": p10_found, "p10_profile": p10_profile}

_SQL = {
    "p3_found": _P3,
    "p5_found": f"WITH r AS ({_RECORDS}), k AS (SELECT *, min(id) OVER (PARTITION BY source_table, bare, marks) AS keep_id FROM r) SELECT source_table, keep_id, id AS copy_id FROM k WHERE id <> keep_id",
    "p5_collapsed": f"WITH r AS ({_RECORDS}) SELECT source_table, min(id) AS keep_id, count(*) AS n_copies FROM r GROUP BY source_table, bare, marks",
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
