"""What a user calls: each report as named DataFrames, ready for ``sinks.json_document`` or further plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lectern.operators import backtest, coverage, linking, mutations, pages, papers, planner, practice, seams, timeline
from lectern.operators.statistics import legacy_note_topics, topic_stats
from lectern.params import DEFAULT, Params
from lectern.scale import cut
from lectern.schemas import require


def _links(notes: DataFrame | None, note_topics: DataFrame | None) -> DataFrame | None:
    """The link table, or what a legacy column of the notes says where there is none."""
    if note_topics is not None:
        return require("note_topics", note_topics)
    return legacy_note_topics(notes) if notes is not None and "topic_ids" in notes.columns else None


def coverage_report(topics: DataFrame, questions: DataFrame, notes: DataFrame | None = None, note_topics: DataFrame | None = None, params: Params = DEFAULT, ref_year: int | None = None) -> dict[str, DataFrame]:
    """The six sections of the coverage panel."""
    stats = topic_stats(topics, questions, _links(notes, note_topics), params, ref_year)
    return {
        "summary": coverage.coverage_summary(stats, topics, questions), "data_quality": coverage.data_quality(questions), "never_asked_topics": coverage.never_asked(stats),
        "out_of_syllabus_questions": coverage.out_of_syllabus(topics, questions), "frequent_without_notes": coverage.frequent_without_notes(stats, params), "heatmap": coverage.topic_year_heatmap(topics, questions),
    }


def study_plan(topics: DataFrame, questions: DataFrame, days_left: int, hours_per_day: float, notes: DataFrame | None = None, note_topics: DataFrame | None = None, params: Params = DEFAULT, ref_year: int | None = None) -> dict[str, DataFrame]:
    """Blocks by day, the summary, and the topics that no longer fit."""
    stats = topic_stats(topics, questions, _links(notes, note_topics), params, ref_year)
    choice = planner.plan_choice(stats, days_left, hours_per_day)
    return {"days": planner.plan_blocks(choice, days_left, hours_per_day), "summary": planner.plan_summary(choice, stats, days_left, hours_per_day), "not_scheduled": planner.not_scheduled(choice)}


def practice_paper(topics: DataFrame, questions: DataFrame, params: Params = DEFAULT, ref_year: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    return {"questions": practice.practice_set(topics, questions, params, ref_year, seed), "pattern": practice.marks_pattern(questions), "typical": practice.typical_paper_marks(topics, questions)}


def backtest_report(topics: DataFrame, questions: DataFrame, params: Params = DEFAULT, top_k: int = 5, min_prior_years: int = 2) -> dict[str, DataFrame]:
    folds = backtest.backtest_folds(topics, questions, params, top_k, min_prior_years)
    return {"per_year": folds, "summary": backtest.backtest_summary(folds), "comparison": backtest.due_score_comparison(folds)}


def lecture_timeline(notes: DataFrame, note_topics: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    tagged = timeline.lecture_topics(notes, note_topics, topics)
    return {"timeline": timeline.timeline(notes), "unscheduled": timeline.unscheduled(notes), "topics": tagged, "units": timeline.lecture_units(tagged), "data_quality": timeline.timeline_quality(notes), "date_conflicts": timeline.date_conflicts(notes)}


def parse_papers(raw_pages: DataFrame, stored: DataFrame | None = None, scanner: Callable[[dict], str] | None = None, global_marks: int | None = None) -> DataFrame:
    """Typed questions of raw pages (document_id, page_number, embedded_text); documents already stored are left out.
    Pages without a usable text layer go to ``scanner`` where one is given."""
    fresh = raw_pages if stored is None else mutations.not_yet_stored(raw_pages, stored)
    read = seams.scanned_text(fresh, scanner) if scanner else fresh.selectExpr("*", "cast(null as string) as ocr_text")
    return papers.with_question_ids(papers.parsed_questions(papers.readable_pages(read), global_marks))


def link_questions(questions: DataFrame, topics: DataFrame, encode: Callable[[list[str]], list[list[float]]], params: Params = DEFAULT) -> DataFrame:
    """Questions with topic_id and repeat_group_id set from embeddings of ``encode``; repeats are sought within topics."""
    q = questions.select("id", linking.question_text(questions["text"], questions["cleaned_text"]).alias("linked_text"))
    vectors = cut(seams.embedded(q, encode))  # used three times; the encoder runs once
    topic_vectors = seams.embedded(topics.select("id", linking.topic_text(topics["name"], topics["syllabus_unit"]).alias("linked_text")), encode)
    unassigned = vectors.join(linking.unassigned(questions).select("id"), "id", "left_semi")
    tagged = mutations.with_topics(questions, linking.assign_topics(unassigned, topic_vectors, params.topic_threshold))
    items = vectors.join(tagged.where("topic_id is not null").select("id", "topic_id"), "id")
    groups = linking.repeat_groups(items, linking.repeat_pairs(items, params.repeat_threshold), linking.last_group(questions))
    return mutations.with_repeat_groups(tagged, groups)


def page_results(words: DataFrame, equations: DataFrame, params: Params = DEFAULT) -> dict[str, DataFrame]:
    """Texts, confidences and review queue of scanned pages."""
    return {"texts": pages.page_texts(pages.block_texts(words), equations), "confidence": pages.page_confidence(words, equations), "review": pages.review_queue(words, equations, params.low_confidence)}
