from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import exports, mutations, pages
from lectern.operators.seams import embedded, pdf_pages, run_kernel, scanned_text, structured_notes
from lectern.plans import records

WORDS = "document_id int, page_number int, region_id string, word_id string, text string, confidence double, x int, y int, line_id int, corrected boolean"
EQS = "document_id int, page_number int, region_id string, latex string, confidence double, render_ok boolean, corrected boolean, x int, y int"


def page(spark):
    words = [(1, 1, "r1", "r1:0", "Force", 0.95, 0, 10, 0, False), (1, 1, "r1", "r1:1", "ecuals", 0.30, 50, 12, 0, False), (1, 1, "r2", "r2:0", "top", 0.8, 0, 2, 0, False), (1, 2, "r1", "r1:0", "x", 0.1, 0, 0, 0, True)]
    equations = [(1, 1, "e1", "F = m a", 0.9, True, False, 0, 20), (1, 1, "e2", "", 0.1, False, False, 0, 30), (1, 3, "e1", "a", 0.9, False, False, 0, 0)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(equations, EQS)


def test_rebuild_and_confidence(spark):
    words, equations = page(spark)
    texts = {r["page_number"]: (r["text"], r["latex"]) for r in pages.page_texts(pages.block_texts(words), equations).collect()}
    assert texts[1] == ("top\n\nForce ecuals\n\n$$ F = m a $$", "F = m a") and texts[3] == ("$$ a $$", "a")
    got = {r["page_number"]: r["confidence"] for r in pages.page_confidence(words, equations).collect()}
    assert got == {1: round(((0.95 + 0.3 + 0.8) / 3 + 0.9) / 2, 4), 2: 0.1, 3: 0.9}


def test_review_and_corrections(spark):
    words, equations = page(spark)
    queue = [(r["kind"], r["item_id"], r["page_number"]) for r in pages.review_queue(words, equations).collect()]
    assert queue == [("equation", "e2", 1), ("word", "r1:1", 1), ("equation", "e1", 3)]
    fixes = spark.createDataFrame([(1, 1, "r1:1", "equals"), (1, 1, "zz", "?")], "document_id int, page_number int, word_id string, text string")
    fixed = pages.corrected_words(words, fixes)
    assert [tuple(r) for r in fixed.where("corrected and page_number = 1").select("word_id", "text", "confidence").collect()] == [("r1:1", "equals", 1.0)]
    assert fixed.columns == words.columns and pages.unknown_corrections(words, fixes).count() == 1
    assert pages.review_queue(words.where("false"), equations.where("false")).count() == 0


def test_folding_keeps_the_first_and_compares_with_kept_pages(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(64), rng.random(64)
    near = a + rng.normal(0, 0.001, 64)
    rows = [(1, 1, a), (1, 2, near), (1, 3, b), (2, 1, a), (1, 4, np.full(64, 0.5)), (1, 5, np.full(64, 0.5)), (1, 6, a)]
    df = spark.createDataFrame([(d, p, [float(x) for x in v]) for d, p, v in rows] + [(1, 7, None), (1, 8, None)], "document_id int, page_number int, fingerprint array<double>")
    got = {(r["document_id"], r["page_number"]): r["source_page_numbers"] for r in pages.fold_pages(df).collect()}
    assert got == {(1, 1): [1, 2, 6], (1, 3): [3], (1, 4): [4], (1, 5): [5], (1, 7): [7], (1, 8): [8], (2, 1): [1]}


def test_chains(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, None), (2, 9, True)], "document_id int, page_number int, joins_previous boolean")
    assert sorted((r["first_page"], r["source_pages"]) for r in pages.stitch_chains(df).collect()) == [(1, "1,2"), (3, "3"), (4, "4"), (9, "9")]


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 10, 0, 0, 10, 10), (1, 11, 2, 2, 4, 4), (1, 12, 500, 500, 5, 5), (2, 20, 0, 0, 10, 10)], "page_id int, box_id long, x int, y int, w int, h int")
    assert [tuple(r) for r in pages.box_pairs(boxes).collect()] == [(1, 10, 11, 0.16, True, False)]
    merges = pages.box_merges(boxes, 1000, 100)
    assert sorted((r["left"], r["right"]) for r in merges.collect()) == [(10, 11)]
    regions = pages.merged_boxes(boxes, spark.createDataFrame([(10, 10), (11, 10)], "node long, root long"), 1000, 1000)
    assert sorted(map(tuple, regions.collect())) == [(1, "r001", 0, 0, 10, 10), (1, "r002", 500, 500, 5, 5), (2, "r001", 0, 0, 10, 10)]


def test_topic_upsert(spark):
    old = spark.createDataFrame([(1, "A", "old", "U"), (2, "B", "b", "U")], "id int, topic_code string, name string, syllabus_unit string")
    new = spark.createDataFrame([("A", "first", "U", 1), ("A", "last", "V", 2), ("C", "c", "W", 3)], "topic_code string, name string, syllabus_unit string, seq int")
    assert sorted(map(tuple, mutations.upsert_topics(old, new).collect())) == [(1, "A", "last", "V"), (2, "B", "b", "U"), (3, "C", "c", "W")]


def test_changes(spark):
    q = spark.createDataFrame([(1, 10, None, None), (2, 11, 2020, "Quiz"), (3, 99, None, None)], "id int, document_id int, year int, exam_type string")
    d = spark.createDataFrame([(10, 2021, "Final"), (11, 2022, "Final")], "id int, year int, exam_type string")
    assert sorted(map(tuple, mutations.children_with_defaults(q, d).collect())) == [(1, 10, 2021, "Final"), (2, 11, 2020, "Quiz"), (3, 99, None, None)]
    assert [r["id"] for r in mutations.orphaned_children(q, d).collect()] == [3]
    assert sorted(r["id"] for r in mutations.without_documents(q, d.where("id = 10")).collect()) == [2, 3]
    assert [r["id"] for r in mutations.not_yet_stored(q, q.where("document_id <> 11")).collect()] == [2]


def test_page_orders_must_fit(spark):
    import pytest

    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "document_id int, page_number int, name string")
    good = spark.createDataFrame([(1, [2, 1])], "document_id int, new_order array<int>")
    assert sorted(map(tuple, mutations.reordered_pages(rows, good).collect())) == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c")]
    with pytest.raises(Exception, match="number of pages"):
        mutations.reordered_pages(rows, spark.createDataFrame([(1, [2])], "document_id int, new_order array<int>")).collect()


def test_flashcards_and_anki(spark):
    notes = spark.createDataFrame([(1, 4, "a\nb\nc", "x^2"), (2, 5, None, None)], "id int, page int, text string, latex string")
    links = spark.createDataFrame([(1, 9), (1, 7)], "note_id int, topic_id int")
    questions = spark.createDataFrame([(5, "Why?", 7, 1), (4, "How?", 7, 1), (3, "No group", 7, None)], "id int, text string, topic_id int, repeat_group_id int")
    card = exports.flashcards(notes, links, questions).collect()
    assert [tuple(c) for c in card] == [(1, "Key concept from page 4", "a b\n\n[Past Exam Context]: How?", 4)]
    cards = spark.createDataFrame([(1, 1, "f", "b\nc", 4), (2, 1, "f", "b", None)], "id int, note_id int, front string, back string, linked_question_id int")
    assert sorted((r["front"], r["back"]) for r in exports.anki_rows(cards, notes, questions).collect()) == [("How?", "a\nb\nc [LaTeX: x^2]"), ("Note Review (Page 4)", "a\nb\nc [LaTeX: x^2]")]
    assert {(r["back"], r["tags"]) for r in exports.anki_rows_all(cards, links).collect()} == {("b<br>c", "study_platform topic_7 topic_9"), ("b", "study_platform topic_7 topic_9")}


def test_kernels_keep_failures_as_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "id int, text string")

    def kernel(record):
        if record["text"] == "bad":
            raise ValueError("broken page")
        return {"n": len(record["text"] or "")}

    got = {r["id"]: (r["n"], r["error"]) for r in run_kernel(df, kernel, "n int", ("id",), retries=1).collect()}
    assert got == {1: (2, None), 2: (None, "ValueError: broken page"), 3: (0, None)}
    assert {r["id"]: r["structured_content"] for r in structured_notes(df, lambda t: t.upper() if t != "bad" else " ").collect()} == {1: "AB", 2: None}
    assert {r["id"]: r["vector"] for r in embedded(df.where("text is not null").withColumnRenamed("text", "linked_text"), lambda ts: [[len(t), 1] for t in ts]).collect()} == {1: [2.0, 1.0], 2: [3.0, 1.0]}


def test_scanner_sees_only_pages_without_text(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 30), (1, 2, "")], "document_id int, page_number int, embedded_text string")
    got = {r["page_number"]: r["ocr_text"] for r in scanned_text(rows, lambda r: f"page {r['page_number']}").collect()}
    assert got == {1: None, 2: "page 2"}


def test_pdf_seam(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    from lectern.sources.readers import binary_files

    got = [(r["page_number"], r["embedded_text"]) for r in pdf_pages(binary_files(spark, str(tmp_path), "*.pdf"), lambda b: b.decode().split("|")).collect()]
    assert got == [(1, "one"), (2, "two")]


def test_corners_and_shares(spark):
    df = spark.createDataFrame([(1, 90, 80), (1, 3, 5), (1, 7, 88), (1, 95, 9)], "page_id int, x int, y int")
    assert {r["corner"]: (r["x"], r["y"]) for r in pages.ordered_corners(df).collect()} == {"top_left": (3, 5), "top_right": (95, 9), "bottom_right": (90, 80), "bottom_left": (7, 88)}
    boxes = spark.createDataFrame([(1, "ab cdef", 10, 70), (2, "", 0, 5)], "box_id int, text string, x int, w int")
    assert [tuple(r) for r in pages.split_by_share(boxes).orderBy("pos").collect()] == [(1, 0, "ab", 10, 20), (1, 1, "cdef", 40, 40)]
    assert [r[0] for r in spark.createDataFrame([(1.7,), (-0.1,), (0.33333,)], "v double").select(pages.scaled(F.col("v"), 1.0)).collect()] == [1.0, 0.0, 0.3333]


def test_upsert_query_keeps_all_stored_pages(spark, tmp_path):
    rows = [(p, 1, p, "2023-01-01", f"t{p}", None, 0.5) for p in range(1, 8)]
    spark.createDataFrame(rows, "id int, document_id int, page int, lecture_date string, text string, latex string, confidence double").write.parquet(f"{tmp_path}/notes.parquet")
    got = {r["page"]: (r["text"], r["lecture_date"]) for r in records.q_upsert_notes(spark, str(tmp_path)).collect()}
    old = {p: (f"t{p}", "2023-01-01") for p in (1, 2, 4, 5, 7)}
    assert got == old | {3: ("T3", "2023-01-01"), 6: ("T6", "2023-01-01"), 8: ("T7", "2024-01-01")}


def test_edit_distances_of_any_script(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs = [("caf\u00e9", "cafe"), ("a\u2014b", "a-bc"), ("\u201cq\u201d", '"q"'), ("plain", "plan")]
    rows = [(i, *p) for i, p in enumerate(pairs)] + [(8, None, "x"), (9, "x", None)]
    spark.createDataFrame(rows, "id int, text string, cleaned_text string").write.parquet(f"{tmp_path}/questions.parquet")
    want = [(i, distance(a, b)) for i, (a, b) in enumerate(pairs)]
    assert sorted(map(tuple, records.q_levenshtein(spark, str(tmp_path)).collect())) == want
    got = records.q_formula_errors(spark, str(tmp_path)).first()
    assert got["samples"] == 4 and got["normalized_edit_distance"] == round(sum(n for _, n in want) / sum(len(a) for a, _ in pairs), 4)
