"""Practice set: a mock paper of real past questions with a historical distribution of marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.hints import with_hints
from lectern.operators.statistics import topic_stats, years_of
from lectern.params import DEFAULT, Params


def marks_pattern(questions: DataFrame) -> DataFrame:
    """(marks, n): the median number of questions of each marks value over all papers (years), half-even, without 0.

    All dated questions with marks count, in the syllabus or not; a paper without a value counts 0 for it.
    """
    per = questions.where("year is not null and marks is not null").groupBy("year", "marks").agg(F.count("*").alias("n"))
    grid = years_of(per).crossJoin(F.broadcast(per.select("marks").distinct()))  # at most 110 years x 100 marks values of a valid table
    filled = grid.join(per, ["year", "marks"], "left").select("marks", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.groupBy("marks").agg(F.bround(F.percentile("n", F.lit(0.5))).cast("long").alias("n")).where("n > 0")


def practice_pool(topics: DataFrame, questions: DataFrame, params: Params = DEFAULT, ref_year: int | None = None) -> DataFrame:
    """(id, marks, topic_id, topic_name, text, year, weight): questions that may be drawn, and their topic's priority.

    Priorities are those of empty notes: whether a topic has notes doesn't change what is likely to be asked.
    """
    stats = topic_stats(topics, questions, None, params, ref_year).select("topic_id", F.col("name").alias("topic_name"), F.greatest("priority", F.lit(0.0)).alias("weight"))
    return questions.where("year is not null and marks is not null").select("id", "marks", "topic_id", "text", "year").join(stats, "topic_id").select("id", "marks", "topic_id", "topic_name", "text", "year", "weight")


def practice_set(topics: DataFrame, questions: DataFrame, params: Params = DEFAULT, ref_year: int | None = None, seed: int = 42) -> DataFrame:
    """The drawn paper: (slot, marks, question_id, topic_id, topic_name, text, year_asked, reused, hints).

    A topic is drawn in proportion to its priority and a question of it evenly: each question gets the key -ln(u)/w,
    with u from a hash of the seed and its id and w its topic's priority over the topic's questions of that value, and
    the smallest keys win, which draws without replacement. The ranking keeps only the rows a value needs before the
    shuffle. Without any priority all topics weigh alike. Slots beyond the pool reuse it in order; a value without any
    question in the pool stays unfilled.
    """
    pool = practice_pool(topics, questions, params, ref_year)
    sizes = pool.groupBy("marks", "topic_id").agg(F.count("*").alias("of_topic"), F.first("weight").alias("tw"))
    value = sizes.groupBy("marks").agg(F.sum("of_topic").alias("in_pool"), F.sum("tw").alias("all_weight"))
    pattern = marks_pattern(questions).withColumnRenamed("n", "slots")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    w = F.when(F.col("all_weight") > 0, F.col("weight")).otherwise(F.lit(1.0)) / F.col("of_topic")
    keyed = pool.join(sizes.drop("tw"), ["marks", "topic_id"]).join(value, "marks").join(pattern, "marks").where(w > 0).withColumn("key", -F.log(u) / w)
    most = pattern.agg(F.max("slots")).first()[0] or 0  # a literal, so that rows no value needs go before the shuffle
    rank = F.row_number().over(Window.partitionBy("marks").orderBy("key", "id"))
    best = keyed.withColumn("place", rank).where(F.col("place") <= most).where(F.col("place") <= F.col("slots"))
    drawn = best.groupBy("marks").agg(F.max("place").alias("n_drawn"))
    slots = pattern.join(drawn, "marks").select("marks", "n_drawn", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("i"))
    filled = slots.select("marks", F.col("i").alias("slot"), (F.pmod(F.col("i") - 1, F.col("n_drawn")) + 1).alias("place"), (F.col("i") > F.col("n_drawn")).alias("reused")).join(best, ["marks", "place"])
    return with_hints(filled, params).select("marks", "slot", F.col("id").alias("question_id"), "topic_id", "topic_name", "text", F.col("year").alias("year_asked"), "reused", "suggested_words", "suggested_minutes")


def typical_paper_marks(topics: DataFrame, questions: DataFrame) -> DataFrame:
    """Median over the years of the in-syllabus marks of a year, in one row; null without any."""
    inside = questions.where("year is not null and marks is not null").join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
    return inside.groupBy("year").agg(F.sum("marks").alias("m")).agg(F.round(F.percentile("m", F.lit(0.5)), 1).alias("typical_paper_marks"))
