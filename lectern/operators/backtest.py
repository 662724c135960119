"""Back-test of the priorities: every exam year held out in turn, all folds in one plan.

Questions are aggregated by (topic, year) once. Each fold joins the rows of its earlier years, so the work grows with
topics x years x folds, never with questions x folds; both due weights share all but the last projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.statistics import by_topic_year, recency_weight, years_of
from lectern.params import DEFAULT, Params


def _scored(topics: DataFrame, questions: DataFrame, params: Params, min_prior_years: int) -> DataFrame:
    """(fold, n_prior, topic_id, base, due, held): parts of the priority and the held-out marks of each topic and fold."""
    per_year = by_topic_year(questions)
    years = years_of(per_year)
    held = years.select(F.col("year").alias("fold"))
    before = held.join(years, F.col("year") < F.col("fold")).withColumn("w", recency_weight(F.col("fold") - 1 - F.col("year"), params))
    folds = before.groupBy("fold").agg(F.count("*").alias("n_prior"), F.sum("w").alias("sum_w")).where(F.col("n_prior") >= max(1, min_prior_years))
    inside = per_year.join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
    train = inside.join(before, "year").groupBy("fold", "topic_id").agg(F.count("*").alias("years_asked"), F.sum(F.col("w") * F.col("marks")).alias("weighted"), F.max("year").alias("last"))
    actual = inside.select(F.col("year").alias("fold"), "topic_id", F.col("marks").alias("held"))
    grid = topics.select(F.col("id").alias("topic_id")).crossJoin(F.broadcast(folds))
    out = grid.join(train, ["fold", "topic_id"], "left").join(actual, ["fold", "topic_id"], "left")
    effort = params.base_effort_hours * params.no_notes_penalty
    base = F.coalesce("weighted", F.lit(0.0)) / F.col("sum_w") / F.lit(effort)
    ratio = (F.col("fold") - F.col("last")) / (F.col("n_prior") / F.col("years_asked"))
    due = F.when(ratio.isNotNull(), F.least(ratio, F.lit(params.due_cap)) / F.lit(params.due_cap)).otherwise(0.0)
    return out.select("fold", "n_prior", "topic_id", base.alias("base"), due.alias("due"), F.coalesce("held", F.lit(0)).cast("double").alias("held"))


def backtest_folds(topics: DataFrame, questions: DataFrame, params: Params = DEFAULT, top_k: int = 5, min_prior_years: int = 2) -> DataFrame:
    """Per held-out year and due weight (``with_due`` true or false): marks share of the top topics, rank correlation.

    Ties of priority go by topic_id for the top, and share their mean rank for the correlation. The share is null when
    the year has no in-syllabus marks, the correlation when priorities or marks are all equal.
    """
    both = F.explode(F.array(F.struct(F.lit(True).alias("with_due"), F.lit(params.due_weight).alias("weight")), F.struct(F.lit(False).alias("with_due"), F.lit(0.0).alias("weight"))))
    rows = _scored(topics, questions, params, min_prior_years).withColumn("v", both).select("*", "v.with_due", "v.weight").drop("v")
    rows = rows.withColumn("priority", F.round(F.col("base") * (1 + F.col("weight") * F.col("due")), 12))
    group = Window.partitionBy("fold", "with_due")  # one row a topic
    mean_rank = lambda c: F.rank().over(group.orderBy(c)) + (F.count("*").over(Window.partitionBy("fold", "with_due", c)) - 1) / 2.0
    ranked = rows.select("*", F.row_number().over(group.orderBy(F.desc("priority"), "topic_id")).alias("place"), mean_rank("priority").alias("rp"), mean_rank("held").alias("rh"))
    total = F.sum("held")
    out = ranked.groupBy("fold", "with_due").agg(
        F.max("n_prior").cast("long").alias("n_prior_years"), F.when(total > 0, F.round(100 * F.sum(F.when(F.col("place") <= top_k, F.col("held")).otherwise(0.0)) / total, 1)).alias("top_k_marks_captured_pct"),
        F.when((F.min("priority") < F.max("priority")) & (F.min("held") < F.max("held")), F.round(F.corr("rp", "rh"), 3)).alias("spearman"), total.alias("total_held_out_marks"),
    )
    return out.withColumnRenamed("fold", "held_out_year")


def backtest_summary(folds: DataFrame) -> DataFrame:
    """Means over the folds per due weight; null values don't count."""
    return folds.groupBy("with_due").agg(F.count("*").alias("n_folds"), F.round(F.avg("top_k_marks_captured_pct"), 1).alias("mean_top_k_marks_captured_pct"), F.round(F.avg("spearman"), 3).alias("mean_spearman"))


def due_score_comparison(folds: DataFrame) -> DataFrame:
    """What the due score adds: both deltas and a verdict, in one row."""
    pick = lambda c, due: F.max(F.when(F.col("with_due") == F.lit(due), F.col(c)))
    one = backtest_summary(folds).agg(
        F.round(pick("mean_top_k_marks_captured_pct", True) - pick("mean_top_k_marks_captured_pct", False), 3).alias("pct_delta"),
        F.round(pick("mean_spearman", True) - pick("mean_spearman", False), 3).alias("spearman_delta"),
    )
    pct, rho = F.coalesce("pct_delta", F.lit(0.0)), F.coalesce("spearman_delta", F.lit(0.0))
    verdict = F.when(F.col("pct_delta").isNull() & F.col("spearman_delta").isNull(), "not enough data").when((pct > 0.5) | (rho > 0.02), "helps").when((pct < -0.5) | (rho < -0.02), "hurts").otherwise("little difference")
    return one.withColumn("verdict", verdict)
