from __future__ import annotations

import random

import pyarrow as pa
import pytest

from lectern.llm import formatting
from lectern.llm.formatting import bare_hashes, collapsed, format_copies, number_text, parsed_imports, same_bare, stored_questions


def bare(text):
    return "".join(c for c in (text or "").lower() if c.isalnum())


TEXTS = ["", "...", "Define  Entropy!", "define entropy", "DEFINE-ENTROPY", "Define entropy 2", "ÉTÉ à 5", "été À5", "İstanbul", "a" * 70_000, "A " * 70_000, "x", "X.", "ß", "日本 語", "日本語"]


@pytest.mark.parametrize("window", [1 << 20, 1000, 7])
def test_hash_depends_on_bare_form_alone(monkeypatch, window):
    monkeypatch.setattr(formatting, "CHUNK", window)
    texts = [t for t in TEXTS if len(t) < 1000] if window == 7 else TEXTS
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["skipped", *texts])[1:]):
        h1, h2 = bare_hashes(column)
        groups = {}
        for t, a, b in zip(texts, h1.tolist(), h2.tolist()):
            groups.setdefault(bare(t), set()).add((a, b))
        assert all(len(v) == 1 for v in groups.values())
        assert len({next(iter(v)) for v in groups.values()}) == len(groups)
    assert bare_hashes(pa.array([None, "", "!"]))[0].tolist() == bare_hashes(pa.array(["", "..", " "]))[0].tolist()


@pytest.mark.parametrize("step_rows", [1, 16, 10_000])
def test_two_pointers_agree_with_canonical_strings(monkeypatch, step_rows):
    monkeypatch.setattr(formatting, "STEP_ROWS", step_rows)
    texts = TEXTS[:9] + TEXTS[11:] if step_rows == 1 else TEXTS
    pairs = [(a, b) for a in texts for b in texts]
    want = [bare(a) == bare(b) for a, b in pairs]
    assert same_bare(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])).tolist() == want
    assert same_bare(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("value,want", [(5, "5"), ("5", "5"), (" 5.0 ", "5"), (5.0, "5"), (100, "100"), ("1e2", "100"), (None, None), ("five", "?five"), (True, "True"), ("nan", "?nan"), (0, "0"), ("-0", "0")])
def test_numbers(value, want):
    assert number_text(value) == want


def rows_of(spark, data):
    return spark.createDataFrame(data, "source_table string, id long, text string, marks string")


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_copies_even_when_hashes_collide(spark, bits):
    rng = random.Random(bits)
    texts = [None, "", "!!", "Define entropy.", "define ENTROPY", "Define entropies", "abc", "a b c", "acb"]
    data = [(s, i, rng.choice(texts), rng.choice([None, "5", "10"])) for s in ("questions", "question_imports") for i in range(120)]
    data += data[:7]  # repeated rows
    sets = {}
    for s, i, t, m in data:
        sets.setdefault((s, bare(t), m), set()).add(i)
    want = sorted((s, min(ids), i) for (s, _, _), ids in sets.items() for i in ids if i != min(ids))
    df = rows_of(spark, data)
    assert sorted(map(tuple, format_copies(df, bits=bits).collect())) == want


def test_hot_sets_are_spread(spark, monkeypatch):
    monkeypatch.setattr("lectern.scale.HOT_ROWS", 1)
    data = [("q", i, ["Define it.", "define IT", "x"][i % 3], "5") for i in range(60)] + [("q", 100 + i, f"t{i}", None) for i in range(40)]
    want = sorted([("q", 0, i) for i in range(1, 60) if i % 3 < 2] + [("q", 2, i) for i in range(5, 60, 3)])
    assert sorted(map(tuple, format_copies(rows_of(spark, data)).collect())) == want


def test_collapsed_counts(spark):
    df = rows_of(spark, [("q", 1, "A b", "5"), ("q", 2, "ab", "5"), ("q", 3, "AB.", "5"), ("q", 4, "ab", None), ("r", 1, "ab", "5")])
    assert sorted(map(tuple, collapsed(df).collect())) == [("q", 1, 3), ("q", 4, 1), ("r", 1, 1)]


def test_empty(spark):
    assert format_copies(rows_of(spark, [])).count() == 0 and collapsed(rows_of(spark, [])).count() == 0


def test_payloads(spark):
    data = [(1, '{"raw_text": "A b", "marks": "5"}'), (2, '{ "marks" : 5.0 , "raw_text":"ab" }'), (3, '{"raw_text": "ab", "mar'), (4, None), (5, "[1]"), (6, '{"raw_text": null}'), (7, "{}"), (None, '{"raw_text": "ab"}')]
    df = spark.createDataFrame(data, "import_id long, payload string").withColumnRenamed("x", "y")
    got = sorted((r["id"], r["text"], r["marks"]) for r in parsed_imports(df).collect())
    assert got == [(1, "A b", "5"), (2, "ab", "5"), (6, None, None), (7, None, None)]
    assert sorted(map(tuple, format_copies(parsed_imports(df)).collect())) == [("question_imports", 1, 2), ("question_imports", 6, 7)]


def test_stored_questions_with_clashing_columns(spark):
    q = spark.createDataFrame([(1, "ab", 5, "h1", 9), (2, "A.B", 5, "h1", 9), (None, "ab", 5, "", 9)], "id int, text string, marks int, h1 string, keep_id int")
    assert sorted(map(tuple, format_copies(stored_questions(q)).collect())) == [("questions", 1, 2)]
