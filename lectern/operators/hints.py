"""Answer-length hints: words and minutes for a question's marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.params import DEFAULT, Params


def suggested_words(marks: Column, params: Params = DEFAULT) -> Column:
    """Linear between the anchors, on with the end slopes outside, never below 0, half-even to the nearest 5."""
    points = params.answer_length_anchors
    value, m = None, marks.cast("double")
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        line = F.lit(float(y0)) + F.lit((y1 - y0) / (x1 - x0)) * (m - F.lit(float(x0)))
        value = F.when(m <= x1, line) if value is None else value.when(m <= x1, line)
    (x0, y0), (x1, y1) = points[-2:]
    value = value.otherwise(F.lit(float(y1)) + F.lit((y1 - y0) / (x1 - x0)) * (m - F.lit(float(x1))))
    return F.when(m > 0, (F.bround(F.greatest(value, F.lit(0.0)) / 5.0) * 5).cast("int"))


def with_hints(questions: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The questions with suggested_words and suggested_minutes; null where marks are null or not positive."""
    return questions.withColumn("suggested_words", suggested_words(F.col("marks"), params)).withColumn("suggested_minutes", F.bround(F.col("suggested_words") / F.lit(params.writing_words_per_minute)).cast("int"))
