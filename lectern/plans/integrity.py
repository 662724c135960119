"""Queries of the general data-quality operators, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.quality import column_profile, load_changes, load_statistics, quality_findings
from lectern.operators.references import Reference, orphan_references, orphans_by_month
from lectern.sources.tables import table


def references(spark: SparkSession, d: str) -> list[Reference]:
    """The referring columns of the domain."""
    q, links = table(spark, d, "questions"), table(spark, d, "note_topics")
    pair = F.concat(F.col("note_id").cast("string"), F.lit(":"), F.coalesce(F.col("topic_id").cast("string"), F.lit("")))
    return [
        Reference("questions.document_id", q, "document_id", F.col("id"), table(spark, d, "source_documents"), "source_documents"),
        Reference("questions.topic_id", q, "topic_id", F.col("id"), table(spark, d, "topics"), "topics"),
        Reference("note_topics.note_id", links, "note_id", pair, table(spark, d, "notes"), "notes"),
        Reference("flashcards.linked_question_id", table(spark, d, "flashcards"), "linked_question_id", F.col("id"), q, "questions"),
    ]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(spark, d), table(spark, d, "deleted_records"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "row_key", "kind")


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, d))


def _orphan_sql() -> str:
    parts = []
    for table_name, key, row_key, parent in (
        ("questions", "document_id", "CAST(c.id AS VARCHAR)", "source_documents"),
        ("questions", "topic_id", "CAST(c.id AS VARCHAR)", "topics"),
        ("note_topics", "note_id", "c.note_id || ':' || coalesce(CAST(c.topic_id AS VARCHAR), '')", "notes"),
        ("flashcards", "linked_question_id", "CAST(c.id AS VARCHAR)", "questions"),
    ):
        parts.append(f"""
        SELECT '{table_name}.{key}' AS ref_field, {row_key} AS row_key, c.created_at,
               CASE WHEN p.id IS NULL AND g.record_id IS NOT NULL THEN 'deleted' WHEN p.id IS NULL THEN 'missing' ELSE 'late' END AS kind
        FROM {table_name} c LEFT JOIN {parent} p ON c.{key} = p.id
        LEFT JOIN (SELECT DISTINCT record_id FROM deleted_records WHERE entity = '{parent}') g ON c.{key} = g.record_id
        WHERE c.{key} IS NOT NULL AND (p.id IS NULL OR p.created_at > c.created_at)""")
    return f"SELECT ref_field, row_key, kind, min(created_at) AS created_at FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality_findings(spark, f"{d}/questions.parquet")


def p7_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return column_profile(spark, f"{d}/questions.parquet")


def p7_load_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = load_statistics(table(spark, d, "questions"))
    return stats.select("load_no", "n_rows", *(F.round(c, 6).alias(c) for c in stats.columns[2:]))


def p7_load_changes(spark: SparkSession, d: str) -> DataFrame:
    changes = load_changes(table(spark, d, "questions"))
    return changes.select("load_no", "column_name", "n_rows", *(F.round(c, 6).alias(c) for c in changes.columns[3:]))


_KINDS = {"id": "i", "question_id": "s", "document_id": "i", "page": "i", "text": "s", "year": "i", "exam_type": "s", "section": "s", "marks": "i", "is_compulsory": "b", "cleaned_text": "s", "topic_id": "i", "repeat_group_id": "i", "created_at": "t", "load_no": "i"}


def _changes_sql() -> str:
    size = {"i": "{}", "s": "length({})", "b": "CAST({} AS INT)", "t": "CAST(NULL AS INT)"}
    parts = [f"SELECT load_no, '{c}' AS column_name, count(*) AS n_rows, 1 - count({c}) / count(*) AS s, avg({size[k].format(c)}) AS m FROM questions WHERE load_no IS NOT NULL GROUP BY load_no" for c, k in _KINDS.items() if c != "load_no"]
    return f"""SELECT load_no, column_name, n_rows, round(s, 6) AS null_share, round(m, 6) AS mean, round(s - lag(s) OVER w, 6) AS null_share_change, round(m / nullif(lag(m) OVER w, 0), 6) AS mean_ratio
        FROM ({" UNION ALL ".join(parts)}) WINDOW w AS (PARTITION BY column_name ORDER BY load_no)"""


_P7_FOUND = r"""
WITH s AS (SELECT load_no, avg(CASE WHEN marks IS NULL THEN 1.0 ELSE 0.0 END) AS marks, avg(CASE WHEN year IS NULL THEN 1.0 ELSE 0.0 END) AS year,
                  avg(CASE WHEN section IS NULL THEN 1.0 ELSE 0.0 END) AS section, avg(CASE WHEN marks BETWEEN 1 AND 100 THEN marks END) AS mean
           FROM questions WHERE load_no IS NOT NULL GROUP BY load_no),
     l AS (SELECT load_no, abs(marks - lag(marks) OVER w) > 0.10 OR mean > 1.5 * lag(mean) OVER w OR lag(mean) OVER w > 1.5 * mean AS marks,
                  abs(year - lag(year) OVER w) > 0.10 AS year, abs(section - lag(section) OVER w) > 0.10 AS section FROM s WINDOW w AS (ORDER BY load_no))
SELECT 'value' AS check_name, 'marks' AS column_name, CAST(id AS VARCHAR) AS item_key FROM questions WHERE marks < 1 OR marks > 100
UNION ALL SELECT 'value', 'year', CAST(id AS VARCHAR) FROM questions WHERE year < 1990 OR year > 2099
UNION ALL SELECT 'value', 'section', CAST(id AS VARCHAR) FROM questions WHERE NOT regexp_full_match(section, '[A-Z]{1,3}|[0-9]{1,2}')
UNION ALL SELECT 'load', 'marks', CAST(load_no AS VARCHAR) FROM l WHERE marks
UNION ALL SELECT 'load', 'year', CAST(load_no AS VARCHAR) FROM l WHERE year
UNION ALL SELECT 'load', 'section', CAST(load_no AS VARCHAR) FROM l WHERE section"""


def _profile_sql() -> str:
    bad = {"marks": "marks < 1 OR marks > 100", "year": "year < 1990 OR year > 2099", "section": "NOT regexp_full_match(section, '[A-Z]{1,3}|[0-9]{1,2}')"}
    parts = []
    for c, kind in _KINDS.items():
        value = f"epoch_us({c})" if kind == "t" else c
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_nulls, count(DISTINCT {c}) AS n_distinct, CAST(min({value}) AS VARCHAR) AS min_value, CAST(max({value}) AS VARCHAR) AS max_value, count(*) FILTER ({bad.get(c, 'false')}) AS n_violations FROM questions")
    return " UNION ALL ".join(parts)


QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month, "p7_found": p7_found, "p7_column_profile": p7_column_profile, "p7_load_statistics": p7_load_statistics, "p7_load_changes": p7_load_changes}

SQL = {
    "p1_found": f"SELECT DISTINCT ref_field, row_key, kind FROM ({_orphan_sql()})",
    "p1_orphans_by_month": f"SELECT ref_field, strftime(created_at, '%Y-%m') AS month, kind, count(*) AS n_refs FROM ({_orphan_sql()}) GROUP BY ALL",
    "p7_found": _P7_FOUND,
    "p7_column_profile": _profile_sql(),
    "p7_load_changes": _changes_sql(),
    "p7_load_statistics": """SELECT load_no, count(*) AS n_rows, round(avg(CASE WHEN marks IS NULL THEN 1.0 ELSE 0.0 END), 6) AS marks_null_share,
        round(avg(CASE WHEN year IS NULL THEN 1.0 ELSE 0.0 END), 6) AS year_null_share, round(avg(CASE WHEN section IS NULL THEN 1.0 ELSE 0.0 END), 6) AS section_null_share,
        round(avg(CASE WHEN marks BETWEEN 1 AND 100 THEN marks END), 6) AS marks_mean FROM questions WHERE load_no IS NOT NULL GROUP BY load_no""",
}
