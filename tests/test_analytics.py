"""The hand-checkable table and the small cases of the analytics."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lectern.operators import backtest, coverage, planner, practice, timeline
from lectern.operators.hints import with_hints
from lectern.operators.statistics import legacy_note_topics, topic_stats
from lectern.params import DEFAULT
from lectern.plans import analytics

FLAT = replace(DEFAULT, recency_half_life_years=None)
Q = "id int, year int, topic_id int, marks int, text string, repeat_group_id int"


@pytest.fixture(scope="module")
def tiny(spark):
    topics = spark.createDataFrame([(1, "T1", "U1"), (2, "T2", "U1"), (3, "T3", "U2"), (4, "T4", "U2")], "id int, name string, syllabus_unit string")
    data = [(i + 1, 2021 + i, 1, 5) for i in range(4)] + [(5, 2021, 2, 10), (6, 2022, 2, 10), (7, 2024, 4, 2), (8, 2023, None, 5), (9, 2023, 99, 5), (10, 2024, 1, None), (11, None, 1, 5)]
    questions = spark.createDataFrame([(*r, "t", None) for r in data], Q)
    links = spark.createDataFrame([(1, 1)], "note_id int, topic_id int")
    return topics, questions, links, topic_stats(topics, questions, links, FLAT).cache()


def by_name(stats):
    return {r["name"]: r for r in stats.collect()}


def test_stats(tiny):
    s = by_name(tiny[3])
    assert (s["T1"]["n_questions"], s["T1"]["expected_marks"], s["T1"]["due_score"], s["T1"]["effort_hours"], s["T1"]["marks_per_hour"]) == (5, 5.0, 0.5, 2.0, 2.5)
    assert s["T1"]["priority"] == pytest.approx(2.875) and s["T2"]["priority"] == pytest.approx(2.45)
    assert (s["T2"]["expected_marks"], s["T2"]["due_score"], s["T2"]["effort_hours"]) == (5.0, 0.75, 2.5)
    assert s["T3"]["priority"] == 0 and s["T3"]["last_asked_year"] is None and s["T3"]["due_score"] == 0
    assert (s["T4"]["expected_marks"], s["T4"]["due_score"]) == (0.5, 0.125)
    assert sum(r["n_questions"] for r in s.values()) == 8


def test_ref_year_zero_means_the_next(tiny, spark):
    topics, questions, links, stats = tiny
    assert by_name(topic_stats(topics, questions, links, FLAT, ref_year=0))["T1"] == by_name(stats)["T1"]


def test_repeats_and_effort_column(spark):
    topics = spark.createDataFrame([(1, "A", "U", 4.0)], "id int, name string, syllabus_unit string, effort_hours double")
    questions = spark.createDataFrame([(1, 2020, 1, 5, "t", 7), (2, 2021, 1, 5, "t", 7), (3, 2021, 1, 5, "t", 8)], Q)
    r = topic_stats(topics, questions).first()
    assert r["max_repeat_count"] == 2 and r["effort_hours"] == 5.0


def test_no_dated_questions_fail(spark, tiny):
    with pytest.raises(Exception, match="question with a year"):
        topic_stats(tiny[0], tiny[1].where("year is null"), tiny[2]).collect()


def test_missing_columns_are_named(tiny):
    with pytest.raises(ValueError, match="questions lacks marks"):
        topic_stats(tiny[0], tiny[1].drop("marks"), tiny[2])


def test_legacy_ids(spark):
    df = spark.createDataFrame([(1, "[1, 2]"), (2, "3,4"), (3, "5"), (4, ""), (5, None), (6, "[]")], "id int, topic_ids string")
    assert sorted(map(tuple, legacy_note_topics(df).collect())) == [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)]


def test_coverage(tiny):
    topics, questions, _, stats = tiny
    s = coverage.coverage_summary(stats, topics, questions).first()
    assert tuple(s) == (4, 3, 1, 11, 2, 47.6)
    assert [r["name"] for r in coverage.never_asked(stats).collect()] == ["T3"]
    assert [r["name"] for r in coverage.frequent_without_notes(stats, FLAT).collect()] == ["T2"]
    assert sorted(r["id"] for r in coverage.out_of_syllabus(topics, questions).collect()) == [8, 9]
    assert tuple(coverage.data_quality(questions).first()) == (11, 1, 1, 1)
    heat = {(r["name"], r["year"]): r["marks"] for r in coverage.topic_year_heatmap(topics, questions).collect()}
    assert [heat["T2", y] for y in (2021, 2022, 2023, 2024)] == [10, 10, 0, 0]


def plan(stats, days, hours):
    choice = planner.plan_choice(stats, days, hours)
    blocks = sorted((r["day"], r["topic"], r["hours"]) for r in planner.plan_blocks(choice, days, hours).collect())
    return choice, blocks, planner.plan_summary(choice, stats, days, hours).first()


def test_plans(tiny):
    stats = tiny[3]
    choice, blocks, summary = plan(stats, 2, 2.25)
    assert {b[1] for b in blocks} == {"T1", "T2"} and summary["hours_unused"] == 0
    choice, blocks, summary = plan(stats, 3, 2.0)
    assert blocks == [(1, "T1", 2.0), (2, "T2", 2.0), (3, "T2", 0.5)] and summary["n_needing_notes"] == 1
    assert [r["name"] for r in planner.not_scheduled(choice).collect()] == ["T4"]
    assert {b[1] for b in plan(stats, 30, 8.0)[1]} == {"T1", "T2", "T4"}


@pytest.mark.parametrize("days,hours", [(0, 3), (5, 0), (-1, 2)])
def test_bad_budgets(tiny, days, hours):
    with pytest.raises(ValueError):
        planner.plan_choice(tiny[3], days, hours)


def test_hints(spark):
    want = {1: (15, 1), 2: (50, 4), 3: (85, 7), 5: (150, 12), 10: (300, 25), 15: (450, 38), 0: (None, None), -5: (None, None), None: (None, None)}
    got = {r["marks"]: (r["suggested_words"], r["suggested_minutes"]) for r in with_hints(spark.createDataFrame([(m,) for m in want], "marks int")).collect()}
    assert got == want


def predictable(spark):
    topics = spark.createDataFrame([(1, "T1", "U"), (2, "T2", "U")], "id int, name string, syllabus_unit string")
    return topics, spark.createDataFrame([(i, 2018 + i, 1, 10, "t", None) for i in range(8)], Q)


def test_backtest(spark):
    topics, questions = predictable(spark)
    folds = backtest.backtest_folds(topics, questions, top_k=1)
    rows = {(r["held_out_year"], r["with_due"]): r for r in folds.collect()}
    assert {y for y, _ in rows} == set(range(2020, 2026))
    assert rows[2022, True]["n_prior_years"] == 4 and rows[2022, True]["total_held_out_marks"] == 10
    assert all(r["top_k_marks_captured_pct"] == 100 for r in rows.values())
    assert {r["held_out_year"] for r in backtest.backtest_folds(topics, questions, min_prior_years=3).collect()} == set(range(2021, 2026))
    assert backtest.due_score_comparison(folds).first()["verdict"] == "little difference"


def test_backtest_of_too_few_years(spark):
    topics, questions = predictable(spark)
    folds = backtest.backtest_folds(topics, questions.where("year < 2020"), min_prior_years=5)
    assert folds.count() == 0 and backtest.due_score_comparison(folds).first()["verdict"] == "not enough data"


def test_frequent_query_reads_all_links(spark, tmp_path):
    spark.createDataFrame([(i, f"T{i}", "U") for i in (1, 2, 3)], "id int, name string, syllabus_unit string").write.parquet(f"{tmp_path}/topics.parquet")
    spark.createDataFrame([(10 * y + t, y, t, 5, "t", None) for y in (2021, 2022, 2023) for t in (1, 2, 3)], Q).withColumn("page", F.lit(1)).write.parquet(f"{tmp_path}/questions.parquet")
    spark.createDataFrame([(1, 1), (2, 3)], "note_id int, topic_id int").write.parquet(f"{tmp_path}/note_topics.parquet")
    assert [r["topic_id"] for r in analytics.q_frequent(spark, str(tmp_path)).collect()] == [2]


def test_practice(spark):
    topics, _ = predictable(spark)
    rows = [(1, 2023, 1, 5), (2, 2023, 1, 10), (3, 2024, 2, 5), (4, 2024, 99, 10), (5, 2024, 1, None)]
    questions = spark.createDataFrame([(*r, "t", None) for r in rows], Q)
    assert sorted(map(tuple, practice.marks_pattern(questions).collect())) == [(5, 1), (10, 1)]
    assert practice.marks_pattern(questions.withColumn("marks", F.lit(None).cast("int"))).count() == 0
    one, two = (sorted(map(tuple, practice.practice_set(topics, questions, seed=4).collect())) for _ in range(2))
    assert one == two and {r[2] for r in one} <= {1, 2, 3} and len(one) == 2
    assert practice.typical_paper_marks(topics, questions).first()[0] == 10.0


def test_practice_reuses_a_small_pool(spark):
    topics, _ = predictable(spark)
    questions = spark.createDataFrame([(1, 2023, 1, 5, "t", None), (2, 2023, 99, 5, "t", None), (3, 2023, 99, 5, "t", None)], Q)
    drawn = practice.practice_set(topics, questions).collect()
    assert len(drawn) == 3 and sorted(r["reused"] for r in drawn) == [False, True, True]


def test_practice_reuses_nothing_while_the_pool_suffices(spark):
    topics, _ = predictable(spark)
    rows = [(i, 2023, 1 + i % 2, 5, "t", None) for i in range(1100)] + [(i, 2023, 1, 10, "t", None) for i in range(1100, 1103)]
    drawn = practice.practice_set(topics, spark.createDataFrame(rows, Q)).collect()
    assert len(drawn) == len({r["question_id"] for r in drawn}) == 1103 and not any(r["reused"] for r in drawn)


def test_timeline(spark):
    topics = spark.createDataFrame([(1, "A", "Unit 1"), (2, "B", "Unit 1")], "id int, name string, syllabus_unit string")
    notes = spark.createDataFrame([(1, 101, "2026-08-10"), (2, 101, "2026-08-10"), (3, 102, "2026-08-05"), (4, 103, None), (5, 104, "2026-08-10"), (6, 104, "2026-08-05")], "id int, document_id int, lecture_date string")
    links = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (9, 1), (1, 77)], "note_id int, topic_id int")
    assert [r["document_id"] for r in timeline.timeline(notes).collect()] == [102, 104, 101]
    assert [r["document_id"] for r in timeline.unscheduled(notes).collect()] == [103]
    assert [(r["document_id"], r["lecture_date"]) for r in timeline.date_conflicts(notes).collect()] == [(104, "2026-08-05")]
    tagged = timeline.lecture_topics(notes, links, topics)
    assert sorted(r["topic_id"] for r in tagged.collect()) == [1, 2]
    assert timeline.lecture_units(tagged).collect()[0]["syllabus_units"] == "Unit 1"
    with pytest.raises(ValueError, match="document_id"):
        timeline.lectures(notes.drop("document_id"))
