"""Queries of the exam analytics, with the SQL they are compared with."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import backtest, coverage, planner, practice, timeline
from lectern.operators.hints import with_hints
from lectern.operators.statistics import largest_repeats, legacy_note_topics, topic_stats
from lectern.params import DEFAULT
from lectern.schemas import rejected_questions, valid_questions
from lectern.sources.tables import table

#: Days and hours of the plan queries.
DAYS, HOURS = 7, 3.0


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "topics"), valid_questions(table(spark, d, "questions")), table(spark, d, "note_topics")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


_REAL = ("year_share", "expected_marks", "due_score", "effort_hours", "marks_per_hour", "priority")


def q_topic_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(topic_stats(*_tables(spark, d)), *_REAL)


def q_topic_stats_no_decay(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(topic_stats(*_tables(spark, d), params=replace(DEFAULT, recency_half_life_years=None)), *_REAL)


def q_topic_stats_ref_year(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(topic_stats(*_tables(spark, d), ref_year=2025), *_REAL)


def q_heatmap(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, _ = _tables(spark, d)
    return coverage.topic_year_heatmap(topics, questions)


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, links = _tables(spark, d)
    return coverage.coverage_summary(topic_stats(topics, questions, links, ref_year=2025), topics, questions)


def q_never_asked(spark: SparkSession, d: str) -> DataFrame:
    return coverage.never_asked(topic_stats(*_tables(spark, d)))


def q_out_of_syllabus(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, _ = _tables(spark, d)
    return coverage.out_of_syllabus(topics, questions)


def q_frequent(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, links = _tables(spark, d)
    return _rounded(coverage.frequent_without_notes(topic_stats(topics, questions, links)), "year_share", "expected_marks")


def q_data_quality(spark: SparkSession, d: str) -> DataFrame:
    return coverage.data_quality(table(spark, d, "questions"))


def q_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rejected_questions(table(spark, d, "questions")).select("id", "year", "marks", "page")


def q_repeats(spark: SparkSession, d: str) -> DataFrame:
    return largest_repeats(_tables(spark, d)[1])


def q_hints(spark: SparkSession, d: str) -> DataFrame:
    return with_hints(table(spark, d, "questions")).select("id", "marks", "suggested_words", "suggested_minutes")


def q_pattern(spark: SparkSession, d: str) -> DataFrame:
    return practice.marks_pattern(_tables(spark, d)[1])


def q_typical(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, _ = _tables(spark, d)
    return practice.typical_paper_marks(topics, questions)


def q_pool(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, _ = _tables(spark, d)
    return practice.practice_pool(topics, questions, ref_year=2025).select("id", "marks", "topic_id", "topic_name", "year", F.round("weight", 6).alias("weight"))


def q_practice_set(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, _ = _tables(spark, d)
    return practice.practice_set(topics, questions, ref_year=2025)


def q_slots(spark: SparkSession, d: str) -> DataFrame:
    """What the drawn paper must look like whatever is drawn: slots, distinct questions and misfits per marks value."""
    topics, questions, _ = _tables(spark, d)
    drawn = practice.practice_set(topics, questions, ref_year=2025)
    own = questions.select(F.col("id").alias("question_id"), F.col("marks").alias("own_marks"))
    return drawn.join(own, "question_id").groupBy("marks").agg(F.count("*").alias("n_slots"), F.count_if(F.col("own_marks") != F.col("marks")).alias("n_misfits"))


def q_timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline.timeline(table(spark, d, "notes"))


def q_unscheduled(spark: SparkSession, d: str) -> DataFrame:
    return timeline.unscheduled(table(spark, d, "notes"))


def q_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return timeline.date_conflicts(table(spark, d, "notes"))


def q_lecture_topics(spark: SparkSession, d: str) -> DataFrame:
    return timeline.lecture_topics(table(spark, d, "notes"), table(spark, d, "note_topics"), table(spark, d, "topics"))


def q_lecture_units(spark: SparkSession, d: str) -> DataFrame:
    return timeline.lecture_units(q_lecture_topics(spark, d))


def q_timeline_quality(spark: SparkSession, d: str) -> DataFrame:
    return timeline.timeline_quality(table(spark, d, "notes"))


def _choice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stats = topic_stats(*_tables(spark, d), ref_year=2025)
    return planner.plan_choice(stats, DAYS, HOURS), stats


def q_plan_choice(spark: SparkSession, d: str) -> DataFrame:
    return _choice(spark, d)[0].select("rank", "topic_id", "name", F.round("hours", 6).alias("hours"), "needs_notes", "chosen")


def q_plan_blocks(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan_blocks(_choice(spark, d)[0], DAYS, HOURS)


def q_plan_summary(spark: SparkSession, d: str) -> DataFrame:
    choice, stats = _choice(spark, d)
    return planner.plan_summary(choice, stats, DAYS, HOURS)


def q_not_scheduled(spark: SparkSession, d: str) -> DataFrame:
    return planner.not_scheduled(_choice(spark, d)[0])


def _folds(spark: SparkSession, d: str) -> DataFrame:
    topics, questions, _ = _tables(spark, d)
    return backtest.backtest_folds(topics, questions)


def q_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d)


def q_backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    return backtest.backtest_summary(_folds(spark, d))


def q_comparison(spark: SparkSession, d: str) -> DataFrame:
    return backtest.due_score_comparison(_folds(spark, d))


def q_legacy_ids(spark: SparkSession, d: str) -> DataFrame:
    legacy = table(spark, d, "note_topics").select(F.col("note_id").alias("id"), F.when(F.col("topic_id") % 2 == 0, F.concat(F.lit("["), "topic_id", F.lit(", 7]"))).when(F.col("topic_id") % 3 == 0, F.concat("topic_id", F.lit(",8"))).otherwise(F.col("topic_id").cast("string")).alias("topic_ids"))
    return legacy_note_topics(legacy)


# ---- SQL -----------------------------------------------------------------------------------------------------------

VALID = r"vq AS (SELECT * FROM questions WHERE page >= 1 AND (marks IS NULL OR marks BETWEEN 1 AND 100) AND (year IS NULL OR year BETWEEN 1990 AND 2099) AND regexp_matches(text, '[^\s\x{a0}]'))"


def _stats_ctes(half_life: float | None = 5.0, ref: int | None = None, links: str = "note_topics", notes: bool = True) -> str:
    weight = f"pow(0.5, (ref - 1 - year) / {half_life})" if half_life else "1.0"
    linked = f"SELECT topic_id, count(*) AS n_notes FROM (SELECT DISTINCT note_id, topic_id FROM {links} WHERE topic_id IS NOT NULL) GROUP BY topic_id" if notes else "SELECT 0 AS topic_id, 0 AS n_notes WHERE false"
    return f"""{VALID},
    py AS (SELECT topic_id, year, count(*) AS n, coalesce(sum(marks), 0) AS marks FROM vq WHERE year IS NOT NULL GROUP BY topic_id, year),
    yr AS (SELECT DISTINCT year FROM py), sc AS (SELECT count(*) AS n_years, {ref if ref else "max(year) + 1"} AS ref FROM yr),
    yw AS (SELECT year, ref, n_years, {weight} AS w FROM yr CROSS JOIN sc), tot AS (SELECT sum(w) AS sum_w, max(ref) AS ref, max(n_years) AS n_years FROM yw),
    ask AS (SELECT topic_id, sum(n) AS n_questions, count(*) AS years_asked, sum(marks) AS total_marks, sum(w * marks) AS weighted, max(py.year) AS last FROM py JOIN yw ON py.year = yw.year WHERE topic_id IS NOT NULL GROUP BY topic_id),
    rep AS (SELECT topic_id, max(n) AS largest FROM (SELECT topic_id, repeat_group_id, count(*) AS n FROM vq WHERE year IS NOT NULL AND repeat_group_id IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1, 2) GROUP BY topic_id),
    nt AS ({linked}),
    s0 AS (SELECT t.id AS topic_id, t.name, t.syllabus_unit, CAST(coalesce(n_questions, 0) AS BIGINT) AS n_questions, CAST(coalesce(years_asked, 0) AS BIGINT) AS years_asked, coalesce(years_asked, 0) / n_years AS year_share,
        CAST(coalesce(total_marks, 0) AS BIGINT) AS total_marks, coalesce(weighted, 0) / sum_w AS expected_marks, last AS last_asked_year, ref - last AS years_since_last,
        CASE WHEN last IS NULL THEN 0 ELSE least((ref - last) / (n_years / years_asked), 2.0) / 2.0 END AS due_score, CAST(coalesce(largest, CASE WHEN n_questions > 0 THEN 1 ELSE 0 END) AS BIGINT) AS max_repeat_count,
        CAST(coalesce(n_notes, 0) AS BIGINT) AS n_notes, coalesce(n_notes, 0) > 0 AS has_notes, 2.0 * CASE WHEN coalesce(n_notes, 0) > 0 THEN 1.0 ELSE 1.25 END AS effort_hours
      FROM topics t LEFT JOIN ask ON t.id = ask.topic_id LEFT JOIN rep ON t.id = rep.topic_id LEFT JOIN nt ON t.id = nt.topic_id CROSS JOIN tot),
    st AS (SELECT *, expected_marks / effort_hours AS marks_per_hour, expected_marks / effort_hours * (1 + 0.3 * due_score) AS priority FROM s0)"""


def _stats_sql(**how) -> str:
    return f"""WITH {_stats_ctes(**how)} SELECT topic_id, name, syllabus_unit, n_questions, years_asked, round(year_share, 6) AS year_share, total_marks, round(expected_marks, 6) AS expected_marks, last_asked_year, years_since_last,
    round(due_score, 6) AS due_score, max_repeat_count, n_notes, has_notes, round(effort_hours, 6) AS effort_hours, round(marks_per_hour, 6) AS marks_per_hour, round(priority, 6) AS priority FROM st"""


_LECTURES = "l AS (SELECT document_id, min(lecture_date) AS lecture_date, count(*) AS n_pages, count(DISTINCT lecture_date) AS n_dates, string_agg(DISTINCT lecture_date, '|' ORDER BY lecture_date) AS dates_found FROM notes GROUP BY document_id)"
_TAGGED = "g AS (SELECT DISTINCT n.document_id, t.id AS topic_id, t.name, t.syllabus_unit FROM notes n JOIN note_topics k ON k.note_id = n.id JOIN topics t ON t.id = k.topic_id)"
_PATTERN = "per AS (SELECT year, marks, count(*) AS n FROM vq WHERE year IS NOT NULL AND marks IS NOT NULL GROUP BY 1, 2), grid AS (SELECT y.year, m.marks, coalesce(per.n, 0) AS n FROM (SELECT DISTINCT year FROM per) y CROSS JOIN (SELECT DISTINCT marks FROM per) m LEFT JOIN per ON per.year = y.year AND per.marks = m.marks), pat AS (SELECT marks, CAST(round_even(quantile_cont(n, 0.5), 0) AS BIGINT) AS n FROM grid GROUP BY marks HAVING round_even(quantile_cont(n, 0.5), 0) > 0)"

_PLAN = f"""WITH RECURSIVE {_stats_ctes(ref=2025)},
    rk AS (SELECT row_number() OVER (ORDER BY round(priority, 9) DESC, topic_id) AS rank, topic_id, name, syllabus_unit, effort_hours AS hours, NOT has_notes AS needs_notes, priority FROM st WHERE priority > 0),
    walk AS (SELECT rank, topic_id, hours <= {DAYS * HOURS} + 1e-9 AS chosen, {DAYS * HOURS} - CASE WHEN hours <= {DAYS * HOURS} + 1e-9 THEN hours ELSE 0 END AS rest FROM rk WHERE rank = 1
        UNION ALL SELECT rk.rank, rk.topic_id, rk.hours <= walk.rest + 1e-9, walk.rest - CASE WHEN rk.hours <= walk.rest + 1e-9 THEN rk.hours ELSE 0 END FROM walk JOIN rk ON rk.rank = walk.rank + 1),
    ch AS (SELECT rk.*, walk.chosen FROM rk JOIN walk ON rk.rank = walk.rank)"""

_FOLDS = f"""WITH {VALID}, py AS (SELECT topic_id, year, coalesce(sum(marks), 0) AS marks FROM vq WHERE year IS NOT NULL GROUP BY 1, 2), yr AS (SELECT DISTINCT year FROM py),
    bf AS (SELECT a.year AS fold, b.year, pow(0.5, (a.year - 1 - b.year) / 5.0) AS w FROM yr a JOIN yr b ON b.year < a.year),
    fo AS (SELECT fold, count(*) AS n_prior, sum(w) AS sum_w FROM bf GROUP BY fold HAVING count(*) >= 2),
    ins AS (SELECT py.* FROM py JOIN topics t ON t.id = py.topic_id),
    tr AS (SELECT fold, topic_id, count(*) AS years_asked, sum(w * marks) AS weighted, max(ins.year) AS last FROM ins JOIN bf ON bf.year = ins.year GROUP BY 1, 2),
    sc AS (SELECT fo.fold, fo.n_prior, t.id AS topic_id, coalesce(weighted, 0) / sum_w / 2.5 AS base, CASE WHEN last IS NULL THEN 0 ELSE least((fo.fold - last) / (n_prior / years_asked), 2.0) / 2.0 END AS due, CAST(coalesce(h.marks, 0) AS DOUBLE) AS held
        FROM topics t CROSS JOIN fo LEFT JOIN tr ON tr.fold = fo.fold AND tr.topic_id = t.id LEFT JOIN ins h ON h.year = fo.fold AND h.topic_id = t.id),
    pr AS (SELECT sc.*, d.with_due, round(base * (1 + d.weight * due), 12) AS priority FROM sc CROSS JOIN (VALUES (true, 0.3), (false, 0.0)) d(with_due, weight)),
    ra AS (SELECT *, row_number() OVER (PARTITION BY fold, with_due ORDER BY priority DESC, topic_id) AS place, rank() OVER (PARTITION BY fold, with_due ORDER BY priority) + (count(*) OVER (PARTITION BY fold, with_due, priority) - 1) / 2.0 AS rp,
        rank() OVER (PARTITION BY fold, with_due ORDER BY held) + (count(*) OVER (PARTITION BY fold, with_due, held) - 1) / 2.0 AS rh FROM pr),
    fd AS (SELECT fold AS held_out_year, with_due, CAST(max(n_prior) AS BIGINT) AS n_prior_years, CASE WHEN sum(held) > 0 THEN round(100 * sum(CASE WHEN place <= 5 THEN held ELSE 0 END) / sum(held), 1) END AS top_k_marks_captured_pct,
        CASE WHEN min(priority) < max(priority) AND min(held) < max(held) THEN round(corr(rp, rh), 3) END AS spearman, sum(held) AS total_held_out_marks FROM ra GROUP BY fold, with_due),
    sm AS (SELECT with_due, count(*) AS n_folds, round(avg(top_k_marks_captured_pct), 1) AS mean_top_k_marks_captured_pct, round(avg(spearman), 3) AS mean_spearman FROM fd GROUP BY with_due)"""

QUERIES = {
    "topic_stats": q_topic_stats, "topic_stats_no_decay": q_topic_stats_no_decay, "topic_stats_ref_year": q_topic_stats_ref_year, "topic_year_heatmap": q_heatmap,
    "coverage_summary": q_summary, "never_asked": q_never_asked, "out_of_syllabus": q_out_of_syllabus, "frequent_without_notes": q_frequent, "data_quality": q_data_quality,
    "rejected_questions": q_rejected, "max_repeat_count": q_repeats, "answer_length_hints": q_hints, "marks_pattern": q_pattern, "typical_paper_marks": q_typical,
    "practice_pool": q_pool, "practice_set": q_practice_set, "practice_set_slots": q_slots, "lecture_timeline": q_timeline, "lecture_unscheduled": q_unscheduled,
    "lecture_date_conflicts": q_conflicts, "lecture_topics": q_lecture_topics, "lecture_units": q_lecture_units, "lecture_quality": q_timeline_quality,
    "study_plan_selection": q_plan_choice, "study_plan_blocks": q_plan_blocks, "study_plan_summary": q_plan_summary, "study_plan_not_scheduled": q_not_scheduled,
    "backtest_folds": q_folds, "backtest_summary": q_backtest_summary, "due_score_comparison": q_comparison, "legacy_topic_ids": q_legacy_ids,
}

SQL = {
    "topic_stats": _stats_sql(),
    "topic_stats_no_decay": _stats_sql(half_life=None),
    "topic_stats_ref_year": _stats_sql(ref=2025),
    "topic_year_heatmap": f"WITH {_stats_ctes()} SELECT t.id AS topic_id, t.name, yr.year, CAST(coalesce(py.marks, 0) AS BIGINT) AS marks FROM topics t CROSS JOIN yr LEFT JOIN py ON py.topic_id = t.id AND py.year = yr.year",
    "coverage_summary": f"WITH {_stats_ctes(ref=2025)} SELECT count(*) AS n_topics, count(*) FILTER (n_questions > 0) AS n_topics_asked, count(*) FILTER (has_notes) AS n_topics_with_notes, (SELECT count(*) FROM vq) AS n_questions, (SELECT count(*) FROM vq WHERE topic_id IS NULL OR topic_id NOT IN (SELECT id FROM topics)) AS n_out_of_syllabus, round(100 * sum(CASE WHEN has_notes THEN expected_marks ELSE 0 END) / sum(expected_marks), 1) AS expected_marks_covered_by_notes_pct FROM st",
    "never_asked": f"WITH {_stats_ctes()} SELECT topic_id, name, syllabus_unit, has_notes FROM st WHERE n_questions = 0",
    "out_of_syllabus": f"WITH {VALID} SELECT id, year, marks, text, document_id, page FROM vq WHERE topic_id IS NULL OR topic_id NOT IN (SELECT id FROM topics)",
    "frequent_without_notes": f"WITH {_stats_ctes()} SELECT topic_id, name, syllabus_unit, years_asked, round(year_share, 6) AS year_share, round(expected_marks, 6) AS expected_marks, max_repeat_count FROM st WHERE year_share >= 0.4 AND NOT has_notes",
    "data_quality": "SELECT count(*) AS n_questions, count(*) FILTER (year IS NULL) AS missing_year, count(*) FILTER (marks IS NULL) AS missing_marks, count(*) FILTER (topic_id IS NULL) AS missing_topic_id FROM questions",
    "rejected_questions": f"WITH {VALID} SELECT id, year, marks, page FROM questions WHERE id NOT IN (SELECT id FROM vq)",
    "max_repeat_count": f"WITH {_stats_ctes()} SELECT topic_id, largest FROM rep",
    "answer_length_hints": "WITH w AS (SELECT id, marks, CASE WHEN marks > 0 THEN CAST(round_even(greatest(CASE WHEN marks <= 5 THEN 50 + 100 / 3.0 * (marks - 2) ELSE 150 + 30.0 * (marks - 5) END, 0) / 5.0, 0) * 5 AS INTEGER) END AS suggested_words FROM questions) SELECT *, CAST(round_even(suggested_words / 12.0, 0) AS INTEGER) AS suggested_minutes FROM w",
    "marks_pattern": f"WITH {VALID}, {_PATTERN} SELECT marks, n FROM pat",
    "typical_paper_marks": f"WITH {VALID} SELECT round(quantile_cont(m, 0.5), 1) AS typical_paper_marks FROM (SELECT year, sum(marks) AS m FROM vq WHERE year IS NOT NULL AND marks IS NOT NULL AND topic_id IN (SELECT id FROM topics) GROUP BY year)",
    "practice_pool": f"WITH {_stats_ctes(ref=2025, notes=False)} SELECT q.id, q.marks, q.topic_id, st.name AS topic_name, q.year, round(greatest(st.priority, 0), 6) AS weight FROM vq q JOIN st ON st.topic_id = q.topic_id WHERE q.year IS NOT NULL AND q.marks IS NOT NULL",
    "practice_set_slots": f"WITH {VALID}, {_PATTERN} SELECT marks, n AS n_slots, 0 AS n_misfits FROM pat WHERE marks IN (SELECT marks FROM vq WHERE year IS NOT NULL AND topic_id IN (SELECT id FROM topics))",
    "lecture_timeline": f"WITH {_LECTURES} SELECT document_id, lecture_date, n_pages FROM l WHERE lecture_date IS NOT NULL",
    "lecture_unscheduled": f"WITH {_LECTURES} SELECT document_id, n_pages FROM l WHERE lecture_date IS NULL",
    "lecture_date_conflicts": f"WITH {_LECTURES} SELECT document_id, lecture_date, n_dates, dates_found FROM l WHERE n_dates > 1",
    "lecture_topics": f"WITH {_TAGGED} SELECT * FROM g",
    "lecture_units": f"WITH {_TAGGED} SELECT document_id, string_agg(DISTINCT syllabus_unit, '|' ORDER BY syllabus_unit) AS syllabus_units FROM g GROUP BY document_id",
    "lecture_quality": f"WITH {_LECTURES} SELECT count(*) AS n_lectures, count(*) FILTER (lecture_date IS NULL) AS n_unscheduled, count(*) FILTER (n_dates > 1) AS n_date_conflicts FROM l",
    "study_plan_selection": f"{_PLAN} SELECT rank, topic_id, name, round(hours, 6) AS hours, needs_notes, chosen FROM ch",
    "study_plan_blocks": f"{_PLAN}, iv AS (SELECT *, sum(hours) OVER (ORDER BY rank) AS e FROM ch WHERE chosen), dy AS (SELECT unnest(range(0, {DAYS})) AS d) SELECT d + 1 AS day, topic_id, name AS topic, syllabus_unit, round(least(e, (d + 1) * {HOURS}) - greatest(e - hours, d * {HOURS}), 2) AS hours, needs_notes, round(priority, 3) AS priority FROM iv JOIN dy ON least(e, (d + 1) * {HOURS}) - greatest(e - hours, d * {HOURS}) > 1e-9",
    "study_plan_summary": f"{_PLAN} SELECT count(*) FILTER (chosen) AS topics_planned, round(coalesce(sum(hours) FILTER (chosen), 0), 2) AS hours_planned, round({DAYS * HOURS} - coalesce(sum(hours) FILTER (chosen), 0), 2) AS hours_unused, round(100 * coalesce(sum(expected_marks) FILTER (chosen), 0) / sum(expected_marks), 1) AS expected_marks_covered_pct, count(*) FILTER (chosen AND needs_notes) AS n_needing_notes FROM st LEFT JOIN ch USING (topic_id)",
    "study_plan_not_scheduled": f"{_PLAN} SELECT rank, topic_id, name FROM ch WHERE NOT chosen",
    "backtest_folds": f"{_FOLDS} SELECT * FROM fd",
    "backtest_summary": f"{_FOLDS} SELECT * FROM sm",
    "due_score_comparison": f"{_FOLDS}, one AS (SELECT round(max(CASE WHEN with_due THEN mean_top_k_marks_captured_pct END) - max(CASE WHEN NOT with_due THEN mean_top_k_marks_captured_pct END), 3) AS pct_delta, round(max(CASE WHEN with_due THEN mean_spearman END) - max(CASE WHEN NOT with_due THEN mean_spearman END), 3) AS spearman_delta FROM sm) SELECT *, CASE WHEN pct_delta IS NULL AND spearman_delta IS NULL THEN 'not enough data' WHEN coalesce(pct_delta, 0) > 0.5 OR coalesce(spearman_delta, 0) > 0.02 THEN 'helps' WHEN coalesce(pct_delta, 0) < -0.5 OR coalesce(spearman_delta, 0) < -0.02 THEN 'hurts' ELSE 'little difference' END AS verdict FROM one",
    "legacy_topic_ids": "SELECT note_id, topic_id FROM note_topics UNION ALL SELECT note_id, 7 FROM note_topics WHERE topic_id % 2 = 0 UNION ALL SELECT note_id, 8 FROM note_topics WHERE topic_id % 2 <> 0 AND topic_id % 3 = 0",
}
