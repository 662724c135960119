from __future__ import annotations

import pytest

from lectern import api
from lectern.session import SETTINGS


@pytest.fixture(scope="module")
def tables(spark):
    topics = spark.createDataFrame([(1, "Sorting", "U1"), (2, "Joins", "U2")], "id int, name string, syllabus_unit string")
    rows = [(i, 2018 + i % 6, 1 + i % 2, 5, f"text {i % 3}", None, None) for i in range(24)] + [(90, 2020, None, 5, "about Joins. U2", None, None), (91, 2020, None, 5, "zz", None, None)]
    return topics, spark.createDataFrame(rows, "id int, year int, topic_id int, marks int, text string, cleaned_text string, repeat_group_id int")


def test_reports_have_their_sections(spark, tables):
    topics, questions = tables
    notes = spark.createDataFrame([(1, "[1]", 7, "2024-01-01")], "id int, topic_ids string, document_id int, lecture_date string")
    report = api.coverage_report(topics, questions, notes)
    assert set(report) == {"summary", "data_quality", "never_asked_topics", "out_of_syllabus_questions", "frequent_without_notes", "heatmap"}
    assert report["summary"].first()["n_topics_with_notes"] == 1
    plan = api.study_plan(topics, questions, 1, 2.0, notes)
    assert [r["topic"] for r in plan["days"].collect()] == ["Sorting"] and plan["not_scheduled"].count() == 1
    assert api.backtest_report(topics, questions)["per_year"].count() == 8
    assert api.practice_paper(topics, questions)["questions"].count() == 4
    links = spark.createDataFrame([(1, 1)], "note_id int, topic_id int")
    assert api.lecture_timeline(notes, links, topics)["topics"].count() == 1


def test_parsing_skips_stored_documents(spark):
    raw = spark.createDataFrame([(1, 1, "QUIZ 2024\nQ1. Explain all of this. [5 marks]"), (2, 1, "x"), (3, 1, "Q1. A stored document is skipped.")], "document_id int, page_number int, embedded_text string")
    stored = spark.createDataFrame([(3,)], "document_id int")
    got = api.parse_papers(raw, stored, scanner=lambda r: "Q9. scanned text of the page").collect()
    assert sorted((r["document_id"], r["question_label"], r["marks"]) for r in got) == [(1, "Q1", 5), (2, "Q9", None)]


def test_linking_by_an_encoder(spark, tables):
    topics, questions = tables
    encode = lambda texts: [[1.0, 0.0, 0.0] if "Joins" in t else [0.0, 1.0, 0.0] if t.startswith("text 0") else [0.0, 0.2, 1.0] if t == "zz" else [0.0, 0.0, 1.0 + len(t)] for t in texts]
    got = {r["id"]: r for r in api.link_questions(questions, topics, encode).collect()}
    assert got[90]["topic_id"] == 2 and len(got) == 26
    assert got[0]["repeat_group_id"] == got[6]["repeat_group_id"] != got[3]["repeat_group_id"]


def test_settings():
    assert SETTINGS["spark.sql.adaptive.enabled"] == "true"
