from __future__ import annotations

import os

import numpy as np
import pytest

from lectern.llm.reading import Model, clauses, fitted, isotonic, level_profile, rank_weights, reading_levels, sentences

EASY = "We see a red cat. The dog runs to the tree. Look at the big sun. Put the cup on the box. It is wet and cold. "
HARD = "Notwithstanding the methodological implications of interoperability, contemporary treatments, particularly of axiomatisation, necessitate reconsideration. Consequently, compositionality subsumes the linearisation of pseudorandom estimators, insofar as stationarity presupposes regularisation. "


def graded(n):
    return [(i, (EASY if i % 2 else HARD) * (1 + i % 4), "en", "s" if i % 3 else None, 1) for i in range(n)]


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, level int")


def test_levels_nulls_and_bounds(spark):
    rows = graded(40)
    docs, labels = frames(spark, rows + [(90, None, "en", "s", 1), (91, "", "en", "s", 1), (92, "cat", None, "s", 1), (None, EASY, "en", "s", 1)], [(i, 1 if i % 2 else 4) for i in range(20)] + [(1, 1), (77, 3), (None, 2), (3, None)])
    got = {r["doc_id"]: r for r in reading_levels(docs, labels).collect()}
    assert set(got) == {*range(40), 92} and all(got[i]["level"] == (1 if i % 2 else 4) for i in range(40))
    assert got[1]["n_words"] == len(rows[1][1].split())
    assert len(fitted(docs, labels, 6).known) == 2
    assert level_profile(reading_levels(docs, labels)).agg({"n_documents": "sum"}).first()[0] == 41


def test_without_grades(spark):
    docs, labels = frames(spark, graded(4), [])
    assert [r["level"] for r in reading_levels(docs, labels).collect()] == [None] * 4
    assert reading_levels(docs.where("false"), labels).count() == 0


def test_most_sentences_decide():
    model = Model([r[1] for r in graded(20)], [1 if i % 2 else 4 for i in range(20)])
    assert model.level(model.score(EASY * 3 + HARD)) == 1 and model.level(model.score(EASY.split(". ")[0] + ". " + HARD * 3)) == 4


def test_isotonic_is_monotone_and_robust():
    rng = np.random.default_rng(0)
    scores = np.concatenate([rng.normal(m, 0.4, 60) for m in (0, 3, 6)])
    levels = np.repeat([1, 2, 3], 60)
    levels[rng.choice(180, 12, replace=False)] = 2
    at, values = isotonic(scores, levels)
    assert (np.diff(at) >= 0).all() and (np.diff(values) >= 0).all()
    assert [round(float(np.interp(x, at, values))) for x in (0, 3, 6)] == [1, 2, 3]


def test_ranker_orders_pairs():
    x = np.array([[0.0, 1], [1, 0], [2, 1], [3, 0]])
    w = rank_weights(x, np.array([1, 2, 3, 4]))
    assert (np.diff(x @ w) > 0).all() and (rank_weights(x, np.array([1, 1, 1, 1])) == 0).all()


def test_sentences():
    assert sentences("One, e.g. this. Two!\n\n* Three\n* Four") == ["One, e.g this.", "Two!", "Three", "Four"]
    assert len(clauses("the cat is red and the dog is big and the sun is hot and the day is long and we run")) == 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_accuracy_on_documents_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/reading_labels.parquet")
    rows = sorted(map(tuple, docs.join(labels, "doc_id").where("text <> ''").select("doc_id", "text", "level").collect()))
    train, test = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if not i % 4]
    model = Model([r[1] for r in train], [r[2] for r in train])
    right = sum(model.level(model.score(t)) == y for _, t, y in test)
    assert right >= 0.9 * len(test)


def test_languages_without_grades_have_no_level(spark):
    docs, labels = frames(spark, graded(20) + [(50, EASY, "de", "s", 1), (51, EASY, None, "s", 1), (52, EASY * 2000, "en", "s", 1)], [(i, 1 if i % 2 else 4) for i in range(20)] + [(52, 4)])
    got = {r["doc_id"]: r["level"] for r in reading_levels(docs, labels).collect()}
    assert got[50] is None and got[51] is None and got[52] == 1  # too long for the sample, but scored whole
