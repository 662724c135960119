"""Edit distances over words and matching ratios: what no built-in expression computes, as Arrow-batched functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from lectern.functions.text import norm_words, squash


def word_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two sequences, a row of the table at a time, vectorised over the shorter one."""
    if len(a) < len(b):
        a, b = b, a
    codes: dict[str, int] = {}
    y = np.array([codes.setdefault(w, len(codes)) for w in b], dtype=np.int64)
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        diagonal = row[:-1] + (y != codes.get(w, -1))
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(diagonal, row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
    return int(row[-1])


@F.pandas_udf(IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else word_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def text_errors(rows: DataFrame, reference: str, found: str) -> DataFrame:
    """One row: samples, reference words, word and character error rates of ``found`` against ``reference``."""
    ref, hyp = norm_words(F.col(reference)), norm_words(F.col(found))
    r, h = F.array_join(ref, " "), F.array_join(hyp, " ")
    counted = rows.where(F.col(reference).isNotNull() & F.col(found).isNotNull()).select(F.size(ref).alias("n"), word_edits(ref, hyp).alias("e"), F.length(r).alias("cn"), F.levenshtein(r, h).alias("ce"))
    rate = lambda e, n: F.round(F.coalesce(F.sum(e), F.lit(0)) / F.greatest(F.coalesce(F.sum(n), F.lit(0)), F.lit(1)), 4)
    return counted.agg(F.count("*").alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("reference_words"), rate("e", "n").alias("word_error_rate"), rate("ce", "cn").alias("char_error_rate"))


def formula_errors(rows: DataFrame, reference: str, found: str, renders: Column) -> DataFrame:
    """One row: samples, exact matches, render rate and edit distance over length, all without white space."""
    ref, hyp = squash(F.coalesce(F.col(reference), F.lit(""))), squash(F.coalesce(F.col(found), F.lit("")))
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(
        F.count("*").alias("samples"), F.round(F.count_if(ref == hyp) / n, 4).alias("exact_match"), F.round(F.count_if((hyp != "") & F.coalesce(renders, F.lit(False))) / n, 4).alias("render_rate"),
        F.round(F.coalesce(F.sum(F.levenshtein(ref, hyp)), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.length(ref)), F.lit(0)), F.lit(1)), 4).alias("normalized_edit_distance"),
    )


def calibration(words: DataFrame, threshold: float) -> DataFrame:
    """One row: mean confidence of right and wrong words, and the share of wrong ones below the threshold; input
    (confidence, is_right)."""
    mean = lambda ok: F.round(F.avg(F.when(F.col("is_right") == F.lit(ok), F.col("confidence"))), 4)
    wrong = F.count_if(~F.col("is_right"))
    return words.agg(mean(True).alias("mean_conf_right"), mean(False).alias("mean_conf_wrong"), F.when(wrong > 0, F.round(F.count_if(~F.col("is_right") & (F.col("confidence") < threshold)) / wrong, 4)).alias("wrong_flagged_share"))
