"""Column profiles of large tables from Parquet footers, dictionaries, and scans only where those don't suffice."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.scale import cut
from lectern.sources.footers import _text, footers, read_chunks, spread


@dataclass(frozen=True)
class Rule:
    """What a column's non-null values must be: within [low, high], or fully matched by a pattern."""

    column: str
    low: int | None = None
    high: int | None = None
    pattern: str | None = None


#: Fixed values of the rules: marks 1 to 100, years 1990 to 2099, sections of one to three letters or one to two digits.
RULES = (Rule("marks", 1, 100), Rule("year", 1990, 2099), Rule("section", pattern="[A-Z]{1,3}|[0-9]{1,2}"))

FOUND = "check_name string, column_name string, item_key string"


def _footer_rows(spark: SparkSession, path: str, rules) -> DataFrame:
    files = spark.read.parquet(path).inputFiles()
    columns = [r.column for r in rules]
    return footers(spark, files, columns, columns)


def suspect_chunks(spark: SparkSession, path: str, rules=RULES) -> DataFrame:
    """(path, row_group, column_name) of the chunks in which some value may break its column's rule.

    A chunk is cleared when all its values are null, when its exact extrema lie within the range, or when its
    dictionary covers all data pages and holds no offending value. Chunks without statistics stay suspect.
    """
    rows = _footer_rows(spark, path, rules)
    suspect = F.lit(False)
    for r in rules:
        if r.pattern:
            clear = F.col("complete") & ~F.exists("items", lambda x: ~x.rlike(rf"\A(?:{r.pattern})\z"))
        else:
            clear = (F.col("min_value").try_cast("double") >= r.low) & (F.col("max_value").try_cast("double") <= r.high)
            clear = F.coalesce(clear, F.lit(False)) | (F.col("complete") & ~F.exists("items", lambda x: ~x.try_cast("double").between(r.low, r.high)))
        item = (F.col("column_name") == r.column) & ~F.coalesce(clear, F.lit(False)) & ~F.coalesce(F.col("n_nulls") == F.col("n_rows"), F.lit(False))
        suspect = suspect | item
    return rows.where(suspect).select("path", "row_group", "column_name")


def broken_values(spark: SparkSession, path: str, key: str = "id", rules=RULES) -> DataFrame:
    """(check_name 'value', column_name, item_key): one row for each value that breaks its column's rule.

    Of the chunks cleared by footers and dictionaries no data page is read. Each other chunk is read alone, with the
    key of its rows. Nulls break no rule, a null key is reported as null. An empty table gives no rows.
    """
    files = len(spark.read.parquet(path).inputFiles())
    if not files:
        return spark.createDataFrame([], FOUND)
    by_column = {r.column: r for r in rules}

    def broken(row: dict, table: pa.Table) -> pa.RecordBatch:
        rule, values = by_column[row["column_name"]], table[row["column_name"]]
        if rule.pattern:
            bad = pc.invert(pc.match_substring_regex(values, rf"\A(?:{rule.pattern})\z"))
        else:
            bad = pc.or_(pc.less(values, rule.low), pc.greater(values, rule.high))
        keys = table[key].filter(bad).cast(pa.string()).combine_chunks()  # a null filter leaves the row out
        return pa.RecordBatch.from_arrays([pa.array([rule.column] * len(keys), pa.string()), keys], names=["column_name", "item_key"])

    chunks = suspect_chunks(spark, path, rules).repartition(spread(spark, files), "path", "row_group")
    rows = read_chunks(chunks, [key], broken, "column_name string, item_key string")
    return rows.select(F.lit("value").alias("check_name"), "column_name", "item_key").distinct()


def load_statistics(table: DataFrame, load: str = "load_no") -> DataFrame:
    """Per load: rows, null shares of marks, year and section, and the mean of marks within 1..100.

    One aggregation with map-side combine; a hot load costs no more than any other. Rows without a load are left out.
    """
    valid = F.when(F.col("marks").between(1, 100), F.col("marks"))
    share = lambda c: (F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"{c}_null_share")
    return table.where(F.col(load).isNotNull()).groupBy(load).agg(F.count("*").alias("n_rows"), share("marks"), share("year"), share("section"), F.avg(valid).alias("marks_mean"))


#: Types whose mean a load's values have; for strings it is the mean length.
NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float")


def load_changes(table: DataFrame, load: str = "load_no") -> DataFrame:
    """(load, column_name, n_rows, null_share, mean, null_share_change, mean_ratio) for every column but ``load``.

    ``mean`` is that of the numbers, of the lengths of strings and the share of true values, null for other types and
    where all values are null. Changes are against the previous load present and null for the first. All columns are
    aggregated in one pass with map-side combine; the window runs over one row a load and column. Rows without a load
    are left out; an empty table gives no rows.
    """
    columns = [(c, t) for c, t in table.dtypes if c != load]
    size = lambda c, t: F.col(f"`{c}`") if t in NUMBERS else F.length(f"`{c}`") if t == "string" else F.col(f"`{c}`").cast("int") if t == "boolean" else F.lit(None).cast("int")
    sums = [x for k, (c, t) in enumerate(columns) for x in (F.count(f"`{c}`").alias(f"_n{k}"), F.avg(size(c, t)).alias(f"_m{k}"))]
    wide = table.where(F.col(load).isNotNull()).groupBy(F.col(load).alias("_load")).agg(F.count("*").alias("_rows"), *sums)
    long = wide.select("_load", "_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (1 - F.col(f"_n{k}") / F.col("_rows")).alias("null_share"), F.col(f"_m{k}").alias("mean")) for k, (c, _) in enumerate(columns)))).alias("x")).select("_load", "_rows", "x.*")
    w = Window.partitionBy("column_name").orderBy("_load")
    return long.select(F.col("_load").alias(load), "column_name", F.col("_rows").alias("n_rows"), "null_share", "mean", (F.col("null_share") - F.lag("null_share").over(w)).alias("null_share_change"), F.try_divide("mean", F.lag("mean").over(w)).alias("mean_ratio"))


def load_shifts(table: DataFrame, load: str = "load_no", null_step: float = 0.10, mean_ratio: float = 1.5) -> DataFrame:
    """(check_name 'load', column_name, item_key): loads that differ from the previous load present.

    A column is reported when its null share differs by more than ``null_step``; marks also when the mean of valid
    marks is more than ``mean_ratio`` times as large or as small. The first load is never reported; a load without
    valid marks has no mean to compare. The window runs over one row a load.
    """
    w = Window.orderBy(load)
    stats = load_statistics(table, load)
    before = lambda c: F.lag(c).over(w)
    moved = {c: F.abs(F.col(f"{c}_null_share") - before(f"{c}_null_share")) > null_step for c in ("marks", "year", "section")}
    now, then = F.col("marks_mean"), before("marks_mean")
    moved["marks"] = F.coalesce(moved["marks"], F.lit(False)) | F.coalesce((now > mean_ratio * then) | (then > mean_ratio * now), F.lit(False))
    flags = stats.select(load, *(c.alias(n) for n, c in moved.items()))
    hits = F.array(*(F.when(F.col(n), F.lit(n)) for n in moved))
    return flags.select(F.lit("load").alias("check_name"), F.explode(F.array_compact(hits)).alias("column_name"), F.col(load).cast("string").alias("item_key"))


def quality_findings(spark: SparkSession, path: str) -> DataFrame:
    """All findings over a questions table: broken values and shifts between loads."""
    return broken_values(spark, path).unionByName(load_shifts(spark.read.parquet(path)))


DESCRIBED = "column_name string, n_rows long, n_nulls long, min_value string, max_value string"


def _described(row: dict, table: pa.Table) -> pa.RecordBatch:
    """Rows, nulls and extrema of a chunk whose footer doesn't have them."""
    values = table[row["column_name"]]
    if pa.types.is_timestamp(values.type):
        values = values.cast(pa.timestamp("us")).cast(pa.int64())
    ends = pc.min_max(values)
    low, high = (None if ends[k].as_py() is None else _text(ends[k].as_py()) for k in ("min", "max"))
    return pa.RecordBatch.from_pylist([{"column_name": row["column_name"], "n_rows": len(values), "n_nulls": values.null_count, "min_value": low, "max_value": high}], pa.schema([("column_name", pa.string()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("min_value", pa.string()), ("max_value", pa.string())]))


def _hashed(column: str, values: list[str]) -> pa.RecordBatch:
    """128-bit hashes of values given as text, each once."""
    texts = np.array(values, dtype=object)
    h1, h2 = (hash_array(texts, hash_key=k, categorize=False) if len(texts) else np.empty(0, np.uint64) for k in ("0123456789abcdef", "fedcba9876543210"))
    return pa.RecordBatch.from_arrays([pa.array([column] * len(texts), pa.string()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["column_name", "h1", "h2"])


def _candidates(row: dict, table: pa.Table) -> pa.RecordBatch:
    """Hashes of the distinct values of a chunk that its dictionary doesn't cover."""
    values = table[row["column_name"]]
    if pa.types.is_timestamp(values.type):
        values = values.cast(pa.timestamp("us")).cast(pa.int64())
    return _hashed(row["column_name"], [_text(x) for x in pc.drop_null(values.unique()).to_pylist()])


def column_profile(spark: SparkSession, path: str, rules=RULES) -> DataFrame:
    """One row per column: rows, nulls, distinct values, least and greatest value as text, violations.

    Rows, nulls and extrema come from the footers of chunks that have them exactly, candidates of distinct values from
    dictionaries that cover their chunk; only the other chunks are read, each alone. Columns are those of numbers,
    strings, booleans and timestamps. Extrema of timestamps are microseconds since 1970, of booleans true and false, of
    strings by code point. Values are counted by 128-bit hashes, grouped first, so no set is held in one task and no
    value but its hash is shuffled. An empty table gives zero counts and null extrema.
    """
    table = spark.read.parquet(path)
    kinds = dict(table.dtypes)
    columns = [c for c in table.columns if kinds[c] in ("int", "bigint", "double", "string", "boolean", "timestamp_ntz", "timestamp")]
    files = table.inputFiles()
    meta = cut(footers(spark, files, columns, columns))
    parts = spread(spark, len(files))

    known = F.col("n_nulls").isNotNull() & (F.col("min_value").isNotNull() | (F.col("n_nulls") == F.col("n_rows")))
    told = meta.where(known).select("column_name", "n_rows", "n_nulls", "min_value", "max_value")
    untold = meta.where(~known).select("path", "row_group", "column_name").repartition(parts, "path", "row_group")
    chunks = told.unionByName(read_chunks(untold, [], _described, DESCRIBED))
    number = lambda c: F.col(c).try_cast("decimal(20,0)")  # noqa: E731 - whole numbers up to 64 bits, timestamps included
    whole, real = F.col("column_name").isin([c for c in columns if kinds[c] not in ("string", "boolean", "double")]), F.col("column_name").isin([c for c in columns if kinds[c] == "double"])
    least = F.when(whole, F.min(number("min_value")).cast("string")).when(real, F.min(F.col("min_value").try_cast("double")).cast("string")).otherwise(F.min("min_value"))
    most = F.when(whole, F.max(number("max_value")).cast("string")).when(real, F.max(F.col("max_value").try_cast("double")).cast("string")).otherwise(F.max("max_value"))
    ranges = chunks.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), least.alias("min_value"), most.alias("max_value"))

    def from_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _hashed(row["column_name"], row["items"])

    hashes = "column_name string, h1 long, h2 long"
    covered = meta.where("complete").select("column_name", "items").mapInArrow(from_dictionary, hashes)
    uncovered = meta.where("not complete and not coalesce(n_nulls = n_rows, false)").select("path", "row_group", "column_name").repartition(parts, "path", "row_group")
    values = covered.unionByName(read_chunks(uncovered, [], _candidates, hashes))
    distinct = values.groupBy("column_name", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("column_name").agg(F.count("*").alias("n_distinct"))

    out = spark.createDataFrame([(c,) for c in columns], "column_name string").join(ranges, "column_name", "left").join(distinct, "column_name", "left")
    if {r.column for r in rules} <= set(columns):
        violations = broken_values(spark, path, columns[0], rules).groupBy("column_name").agg(F.count("*").alias("n_violations"))
    else:
        violations = spark.createDataFrame([], "column_name string, n_violations long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.join(violations, "column_name", "left").select("column_name", zero("n_rows"), zero("n_nulls"), zero("n_distinct"), "min_value", "max_value", zero("n_violations"))
