"""Parser literals: one behaviour a case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import papers
from lectern.schemas import rejected_questions, valid_questions


def value(spark, expression, *texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("text,source,want", [
    ("normal-\nization", "ocr", "normalization"), ("normal-\nization", "embedded", "normal-\nization"), ("nor-\nmal-\nization", "ocr", "normalization"),
    ("a\r\nb\rc", "embedded", "a\nb\nc"), ("a  \t\nb", "embedded", "a\nb"), ("a    b", "embedded", "a b"), ("a\n\n\n\nb", "embedded", "a\n\nb"), (None, "ocr", ""), ("", "ocr", ""),
    ("x\n1\ny", "embedded", "x\ny"), ("x\n- 2 -\ny", "embedded", "x\ny"), ("Page 3\ny", "embedded", "y"), ("x\nPage 3 of 10", "embedded", "x"), ("x\n3 of 10\n[4]\ny", "embedded", "x\ny"),
    ("x\n---\ny", "embedded", "x\n---\ny"), ("x\n-------------\ny", "embedded", "x\ny"), ("é 2", "embedded", "é 2"),
])
def test_normalize(spark, text, source, want):
    assert value(spark, lambda c: tx.normalize(c, F.lit(source)), text) == [want]


def test_usable(spark):
    assert value(spark, tx.usable, "Q1. Explain norms.", "Q1. Explain the norms. Now", None, " \n\t " * 30) == [False, True, False, False]


def test_year(spark):
    got = value(spark, tx.extract_year, "END SEMESTER EXAMINATION 2025", "Copyright 2019. END SEMESTER EXAMINATION 2025.", "Historical paper from 1850. Exam 2025.", "Question Bank", "a2025b", "2019 " + "x" * 150 + " exam 2001", "1989 2100", "", None, "2001 2003")
    assert got == [2025, 2025, 2025, None, None, 2001, None, None, None, 2003]


def test_exam_type(spark):
    got = value(spark, tx.extract_exam_type, "B.Tech END SEMESTER EXAM", "Mid-Term", "INTERNAL ASSESSMENT", "international", "Supplementary quiz", "quiz", "Model exam", None)
    assert got == ["End Semester", "Mid Semester", "Internal", None, "Supplementary", "Quiz", "Model Exam", None]


def test_marks(spark):
    got = value(spark, tx.extract_marks, "Q1. [5 marks]", "(3 Marks)", "10 marks", "Marks: 7", "Define (05)", "[0 marks]", "[100 marks]", "[500 marks] (4)", "none", None, "99999999999999 marks")
    assert got == [5, 3, 10, 7, 5, None, 100, 4, None, None, None]
    assert value(spark, tx.extract_global_marks, "Each question carries 5 marks.", "All questions carry equal marks (10)", "2 marks each", "Answer any THREE") == [5, 10, 2, None]


def test_compulsory(spark):
    assert value(spark, tx.extract_compulsory, "(Compulsory) x", "Answer any THREE", "Attempt all", "x", None, "optional compulsory") == [True, False, True, None, None, True]


def test_labels_and_kinds(spark):
    texts = ["Q1. x", "q.2) x", "3. abc", "1.", "100. x", "(a) x", "(iii) x", "SECTION B: x", "Part of the", "plain", ""]
    assert value(spark, tx.line_kind, *texts) == ["main", "main", "main", None, None, "sub", "sub", "section", "section", None, None]
    assert value(spark, tx.label_of, *texts) == ["Q1", "Q2", "3", "1", "100.", "(a)", "(iii)", "SECTION", "Part", "plain", "?"]
    assert value(spark, tx.section_of, "SECTION B: x", "part ii", "x", "Part of the") == ["B", "II", None, "OF"]


def pages(spark, *texts, source="embedded"):
    return spark.createDataFrame([(1, i + 1, t, source) for i, t in enumerate(texts)], "document_id int, page_number int, text string, source string")


def parsed(spark, *texts, **how):
    return papers.parsed_questions(pages(spark, *texts), **how).orderBy("page", "seg_no").collect()


def test_sections_carry_over_pages(spark):
    got = parsed(spark, "END SEMESTER EXAMINATION 2025\nSECTION A\nQ1. Explain this. [5 marks]\n(a) first part\n(b) second", "Q2. More\ntext\nSECTION B\nQ3. Last one here", "nothing", "Q4. End")
    assert [(r["question_label"], r["question_type"], r["section"]) for r in got] == [("Q1", "main", "A"), ("(a)", "sub", "A"), ("(b)", "sub", "A"), ("Q2", "main", "A"), ("Q3", "main", "B"), ("Q4", "main", "B")]
    assert got[3]["raw_text"] == "Q2. More\ntext\nSECTION B" and got[0]["marks"] == 5
    assert {r["year"] for r in got} == {2025} and {r["exam_type"] for r in got} == {"End Semester"}
    assert parsed(spark, "Q2. More\ntext\nSECTION B\nQ3. Last one here", strict_sections=True)[0]["raw_text"] == "Q2. More\ntext"


def test_global_marks_are_a_fallback(spark):
    assert [r["marks"] for r in parsed(spark, "Q1. Explain SQL. [5 marks]\nQ2. Explain.", global_marks=10)] == [5, 10]


def test_pages_without_questions_and_empty_input(spark):
    assert parsed(spark, "2025. Not a question", "1.", "", None) == []
    assert papers.parsed_questions(pages(spark).where("false")).count() == 0


def test_readable_pages(spark):
    df = spark.createDataFrame([(1, 1, "x" * 25, "scan"), (1, 2, "short", "scanned"), (1, 3, None, None), (1, 4, "short", " \n")], "document_id int, page_number int, embedded_text string, ocr_text string")
    assert sorted((r["page_number"], r["source"], r["text"]) for r in papers.readable_pages(df).collect()) == [(1, "embedded", "x" * 25), (2, "ocr", "scanned")]


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, 2, 2025, "End Semester"), (2, 3, 2020, "Quiz")], "document_id int, n_questions int, year int, exam_type string")
    df = papers.parsed_questions(pages(spark, "END SEMESTER EXAMINATION 2025\nQ1. Explain. [5 marks]\nQ2. Why? (3 marks)"))
    got = {r["document_id"]: r["accuracy_score"] for r in papers.evaluation(df, expected).collect()}
    assert got == {1: 100.0, 2: 0.0}


def test_ids_are_stable(spark):
    df = papers.with_question_ids(papers.parsed_questions(pages(spark, "Q1. Explain.\nQ2. Why?")))
    ids = [r["question_id"] for r in df.collect()]
    assert len(set(ids)) == 2 and all(i.startswith("q-") and len(i) == 34 for i in ids) and ids == [r["question_id"] for r in df.collect()]


def test_validation(spark):
    rows = [(1, 1, "x", 2020, 5), (2, 0, "x", 2020, 5), (3, 1, "  ", 2020, 5), (4, 1, "x", 1989, 5), (5, 1, "x", None, None), (6, 1, "x", 2020, 101), (7, None, "x", 2020, 5), (8, 1, None, 2020, 5)]
    df = spark.createDataFrame(rows, "id int, page int, text string, year int, marks int")
    assert sorted(r["id"] for r in valid_questions(df).collect()) == [1, 5]
    assert valid_questions(df).count() + rejected_questions(df).count() == len(rows)


def test_latex(spark):
    assert value(spark, tx.latex_balanced, r"\frac{a}{b}", r"{a", r"}{", r"\{ a", r"\begin{x}a\end{x}", r"\begin{x}a", "") == [True, False, False, True, True, False, True]
