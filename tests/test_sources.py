from __future__ import annotations

import json
import sqlite3

import pytest

from lectern.functions.editing import calibration, formula_errors, match_ratio, text_errors, word_distance
from lectern.operators.exports import markdown_pages, question_query
from lectern.sources import readers, sinks
from lectern.streaming.ingest import current_notes, ingest_notes, ingest_papers

CSV = "﻿Code,Topic Name,Module\nA-1, Sorting ,Unit 1\nA-2,,Unit 1\n\"B,1\",\"Joins, all\",Unit 2\n"


def test_syllabus(spark, tmp_path):
    (tmp_path / "s.csv").write_text(CSV, encoding="utf-8")
    want = [("A-1", "Sorting", "Unit 1"), ("B,1", "Joins, all", "Unit 2")]
    assert sorted(map(tuple, readers.syllabus_csv(spark, str(tmp_path / "s.csv")).collect())) == want
    assert sorted(map(tuple, readers.syllabus_text(spark, CSV).collect())) == want
    with pytest.raises(ValueError, match="syllabus_unit"):
        readers.syllabus_text(spark, "code,name\na,b\n")


def test_json_and_sidecars(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"topic_code": "A", "name": "x"}, {"topic_code": "B"}]))
    assert sorted(map(tuple, readers.json_records(spark, str(tmp_path / "q.json"), "topic_code string, name string").collect())) == [("A", "x"), ("B", None)]
    for d, p in ((2, 10), (2, 9), (1, 1)):
        (tmp_path / "side" / str(d)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "side" / str(d) / f"page_{p}.json").write_text("{}")
    assert [(r["document_id"], r["page_number"]) for r in readers.page_sidecars(spark, str(tmp_path / "side/*/*.json")).collect()] == [(1, 1), (2, 9), (2, 10)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table topics (id integer, topic_code text, name text, syllabus_unit text, extra text)")
        db.executemany("insert into topics values (?, ?, ?, ?, 'e')", [(1, "A", "a", "U"), (2, "B", None, "U")])
    assert sorted(map(tuple, readers.sqlite_table(spark, path, "topics").collect())) == [(1, "A", "a", "U"), (2, "B", None, "U")]
    with pytest.raises(FileNotFoundError):
        readers.sqlite_table(spark, path + "x", "topics")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, 1, 1, 'a "b", c'), (2, None, 1, 2, None)], "id int, year int, document_id int, page int, text string")
    sinks.questions_by_year(df, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    assert back.where("year = 2020").count() == 1 and "PartitionFilters: [isnotnull(year" in back.where("year = 2020")._jdf.queryExecution().toString()
    sinks.append(df, str(tmp_path / "a"))
    sinks.append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    sinks.csv_file(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').where("id = 1").first()["text"] == 'a "b", c'
    sinks.json_document(str(tmp_path / "d.json"), rows=df.orderBy("id"))
    assert json.loads((tmp_path / "d.json").read_text())["rows"][1] == {"id": 2, "year": None, "document_id": 1, "page": 2, "text": None}
    notes = spark.createDataFrame([(2, 1, 2, None, "two", None), (1, 1, 1, "2024-01-01", "one", "x")], "id int, document_id int, page int, lecture_date string, text string, latex string")
    sinks.markdown_document(markdown_pages(notes), str(tmp_path / "n.md"), "Notes")
    assert (tmp_path / "n.md").read_text().startswith("# Notes\n\n## Page 1\n**Lecture Date:** 2024-01-01\n\none\n\n**Equations:**\n$$\nx\n$$\n\n---\n\n## Page 2\ntwo\n\n---")


def test_question_query_precedence(spark):
    df = spark.createDataFrame([(1, 1, 1, 2020, "a"), (2, 1, 1, 2021, "B"), (3, 2, 1, 2020, None)], "id int, document_id int, page int, year int, section string")
    ids = lambda **how: [r["id"] for r in question_query(df, **how).collect()]
    assert ids(document_id=1, year=2020) == [1, 2] and ids(year=2020) == [1, 3] and ids(section=" A ") == [1] and ids() == [2, 1, 3]


def test_edit_distances(spark):
    assert word_distance("a b c".split(), "a x c d".split()) == 2 and word_distance([], ["a"]) == 1 and word_distance(["a"], []) == 1
    df = spark.createDataFrame([("The cat sat", "the  cat sit", 1.0), (None, "x", 0.0), ("a b", "a b", 1.0)], "r string, h string, k double")
    assert tuple(text_errors(df, "r", "h").first()) == (2, 5, 0.2, round(1 / 14, 4))
    assert tuple(formula_errors(df.where("r is not null"), "r", "h", df["k"] > 0).first())[0] == 2
    assert [r[0] for r in df.select(match_ratio("r", "h")).collect()][1] is None
    words = spark.createDataFrame([(0.9, True), (0.5, False), (0.7, False)], "confidence double, is_right boolean")
    assert tuple(calibration(words, 0.6).first()) == (0.9, 0.6, 0.5)


def test_papers_stream_once(spark, tmp_path):
    schema = "document_id int, page_number int, text string, source string"
    incoming, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: ingest_papers(spark, incoming, table, mark).awaitTermination()
    spark.createDataFrame([(1, 1, "QUIZ 2024\nQ1. One? [5 marks]", "embedded")], schema).write.mode("append").parquet(incoming)
    run()
    run()
    assert [(r["document_id"], r["marks"], r["year"]) for r in spark.read.parquet(table).collect()] == [(1, 5, 2024)]
    spark.createDataFrame([(1, 1, "Q1. Again", "embedded"), (2, 1, "Q1. New", "embedded")], schema).write.mode("append").parquet(incoming)
    run()
    assert sorted((r["document_id"], r["raw_text"]) for r in spark.read.parquet(table).collect()) == [(1, "Q1. One? [5 marks]"), (2, "Q1. New")]


def test_notes_stream_upserts(spark, tmp_path):
    schema = "document_id int, page int, lecture_date string, taken_at string, text string, latex string, confidence double"
    incoming, folder, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in ([(1, 1, "2024-01-01", None, "old", None, 0.5), (1, 2, None, "2024-02-02", "two", None, 0.5)], [(1, 1, None, None, "new", "x", 0.9)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(incoming)
        ingest_notes(spark, incoming, folder, mark).awaitTermination()
    got = sorted((r["page"], r["lecture_date"], r["text"], r["latex"]) for r in current_notes(spark, folder).collect())
    assert got == [(1, "2024-01-01", "new", "x"), (2, "2024-02-02", "two", None)]
