from __future__ import annotations

import os

import pytest

from lectern.llm.scans import LABELS, LOOKALIKES, LineModel, Repairer, counted_words, defects_found, gold_labels, known_words, line_features, lines_of, misreadings, repaired, spelled, SPELLED

CLEAN = "Today we looked at the closed system and its entropy. The remaining values follow step by step.\n\nReadings\n12\n7\n30"
NOISY = [
    "Today we looked at the closed sys-\ntem and its entropy. The remaining values\nfollow step by step.\n- 4 -\n\nReadings\n12\n7\n30",
    "LECTURE NOTES PHYSICS (ALDERON)\nToday we looked at the closed system\nand its entropy. The remaining values follow\nstep by step.\n\nReadings\n12\n7\n30",
    "Today we looked at the closed system and\nMidland College - Physics | 4\nits entropy. The remaining values follow\nstep by step.\n\nReadings\n12\n7\n30\nPage 4 of 9",
    "4   Lecture notes Physics (Alderon)\nToday we looked at the closed system and its\nentropy. The remaining values follow step by step.\n\nReadings\n12\n7\n30",
]


@pytest.fixture(scope="module")
def model():
    examples = []
    for t in NOISY * 5:
        lines = lines_of(t)
        examples.append((line_features(lines, 4), gold_labels(lines, CLEAN)))
    return LineModel().fit(examples)


@pytest.fixture
def reader(model):
    words = {w: 1000 for w in "today we looked at the closed system and its entropy remaining values follow step by readings holds first order group modern".split()} | {"first-order": 500}
    return Repairer(words, model)


def test_gold_labels():
    assert [LABELS[i] for i in gold_labels(lines_of(NOISY[0]), CLEAN)] == ["body", "body", "body", "number", "break", "body", "body", "body", "body"]
    assert gold_labels(lines_of(NOISY[2]), CLEAN)[1] == 2 and gold_labels(lines_of(NOISY[2]), CLEAN)[-1] == 3


@pytest.mark.parametrize("text,defects", list(zip(NOISY, (["hyphen", "page_number"], ["header"], ["header", "page_number"], ["header"]))))
def test_defects_and_paragraphs(reader, text, defects):
    found, clean = reader.read(text, 4)
    assert found == defects and clean == CLEAN


@pytest.mark.parametrize("text,want", [
    ("we holds the system", []), ("we bolds the sys+em", ["misread"]), ("the 9roiip and entr0py", ["misread"]), ("a first-\norder system", []), ("the remai¬\nning values", ["hyphen"]), ("the remai\xad\nning values", ["hyphen"]),
    ("the sysetm and its vlaues", []), ("values 5081 and 16 of x1", []), ("", []), ("   \n \n", []), ("the modem system", ["misread"]), ("the values –\nthe system", []),
])
def test_words(reader, text, want):
    assert reader.read(text, 1)[0] == want


def test_repair_keeps_case(reader):
    assert reader.fixed("Tbe SYS+EM 9roup, Entr0py.") == "The SYSTEM group, Entropy."


def tables(spark):
    notes = [(i, 1, t, 4, "x") for i, t in enumerate(NOISY * 3)] + [(90, 1, None, 4, "x"), (91, 1, "", 4, "x"), (None, 1, "a", 4, "x"), (92, 1, "we looked at the sys+em", None, "x"), (92, 1, "we looked at the sys+em", None, "x")]
    questions = [(1, 5, NOISY[0], 2, "y"), (2, 5, "plain " + "text " * 30_000, 2, "y")]
    n = spark.createDataFrame(notes, "id int, document_id int, text string, page int, defect string")
    q = spark.createDataFrame(questions, "id int, document_id int, text string, page int, source_table string")
    return q, n, spark.createDataFrame([(i, CLEAN) for i in range(8)] + [(0, CLEAN), (None, CLEAN), (5, None)], "note_id int, clean_text string")


def test_operator(spark):
    q, n, t = tables(spark)
    got = sorted(map(tuple, defects_found(q, n, t).collect()))
    assert ("notes", 0, "hyphen") in got and ("notes", 1, "header") in got and ("notes", 92, "misread") in got and ("questions", 1, "hyphen") in got
    assert len(got) == len(set(got)) and not [r for r in got if r[1] in (90, 91) or r[:2] == ("questions", 2)]
    texts = {(r["source_table"], r["record_id"]): r["clean_text"] for r in repaired(q, n, t).collect()}
    assert texts["notes", 1] == CLEAN and texts["notes", 92] == "we looked at the system"
    assert defects_found(q.where("false"), n.where("false"), t).count() == 0
    assert defects_found(q, n, t.where("false")).count() > 0


def test_counts_tell_broken_words_apart(spark):
    df = spark.createDataFrame([("Sys-\ntem system first-order 12 12",), ("well-\nknown well-known",), (None,), ("",)], "text string")
    got = {r["w"]: (r["n"], r["alone"]) for r in counted_words(df).collect()}
    assert got == {"system": (2, 1), "first-order": (1, 1), "first": (1, 1), "order": (1, 1), "wellknown": (1, 0), "well-known": (1, 1), "well": (1, 1), "known": (1, 1)}


def test_every_misreading_has_the_folded_form_of_its_word(spark):
    for wrong, right in LOOKALIKES:
        assert wrong.translate(str.maketrans(SPELLED)) == right.translate(str.maketrans(SPELLED))
        assert misreadings(f"x{wrong}y", f"x{right}y") == 1
    assert misreadings("@lloc@tor", "allocator") == 1 and misreadings("9roiip", "group") == 2 and misreadings("east", "cast") is None and misreadings("ab", "abc") is None
    df = spark.createDataFrame([("9roiip corner comer münze 61",)], "w string")
    assert df.selectExpr(f"{spelled('w')} as f").first()[0] == "9roiip corner comer münze 61".translate(str.maketrans(SPELLED))


def test_known_words(spark):
    counts = [("receives", 900, 900), ("rcccivcs", 2, 2), ("the", 5000, 5000), ("tbe", 30, 30), ("hat", 40, 40), ("bat", 300, 300), ("countcrexample", 1, 0), ("counterexample", 8, 7), ("r" * 5000 + "c", 1, 1), ("r" * 5000 + "e", 90, 90)]
    got = {r["w"]: (r["alone"], r["true_word"]) for r in known_words(spark.createDataFrame(counts, "w string, n long, alone long")).collect()}
    assert got["rcccivcs"] == (2, "receives") and got["tbe"][1] == "the" and got["hat"][1] is None and got["countcrexample"] == (7, "counterexample") and got["r" * 5000 + "c"][1] == "r" * 5000 + "e" and len(got) == len(counts)


def test_defects_depend_neither_on_the_share_nor_on_the_size_of_the_corpus(spark):
    """The same texts beside a hundred times as many others, and with all or no words in the tasks."""
    q, n, t = tables(spark)
    rare = [(7, 5, "An isobutylcne flask and isobutylene again: isobutylene isobutylene isobutylene isobutylene.", 2, "y"), (8, 5, "Today we looked at the closed note-\nbook and its entropy, our notebook.", 2, "y"), (9, 5, "Today we looked at the closed well-\nknown system, a well-known one.", 2, "y")]
    q = q.unionByName(spark.createDataFrame(rare, q.schema))
    want = sorted(map(tuple, defects_found(q, n, t, share=1e-12).collect()))
    assert {(i, d) for s, i, d in want if s == "questions" and i > 6} == {(7, "misread"), (8, "hyphen")}
    assert sorted(map(tuple, defects_found(q, n, t, share=1.0).collect())) == want
    more = spark.range(1000, 1400).selectExpr("cast(id as int) as id", "9 as document_id", "'Copper wire carries a steady current while the pendulum swings.' as text", "2 as page", "'y' as source_table")
    assert [r for r in sorted(map(tuple, defects_found(q.unionByName(more), n, t, share=1e-3).collect())) if r[1] < 1000] == want
    texts = {share: sorted(map(tuple, repaired(q, n, t, share=share).select("source_table", "record_id", "defects", "clean_text").collect())) for share in (1e-12, 1.0)}
    assert texts[1e-12] == texts[1.0]
    assert sorted({(s, i, d) for s, i, ds, _ in texts[1.0] for d in ds}) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_transcripts_are_restored(spark):
    d = "/root/testdata/sf0.01"
    q, n, t = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("questions", "notes", "note_transcripts"))
    held = t.where("note_id % 3 = 0")
    got = repaired(q, n, t.where("note_id % 3 <> 0")).where("source_table = 'notes'").withColumnRenamed("record_id", "note_id").join(held.withColumnRenamed("clean_text", "want"), "note_id").collect()
    assert len(got) > 5 and sum(r["clean_text"] == r["want"] for r in got) >= 0.8 * len(got)
