"""Readers of everything that isn't a Parquet table: syllabus CSV, JSON fixtures, page sidecars, databases, files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schemas import DDL

#: Header names that stand for each role of a syllabus, in the order in which they are tried; fixed values.
SYLLABUS_ROLES = {
    "topic_code": ("topic_code", "code", "id", "topic_id"),
    "name": ("name", "topic_name", "topic", "title", "description"),
    "syllabus_unit": ("syllabus_unit", "unit", "module", "chapter", "section"),
}


#: Alias to role, and what the order of the aliases of a role is.
_ALIASES = {alias: (role, rank) for role, names in SYLLABUS_ROLES.items() for rank, alias in enumerate(names)}
_FOLDED = str.maketrans({" ": "_", "-": "_", "\ufeff": None})


def header_key(header: str) -> str:
    """Header in lower case, without a byte order mark, with blanks and hyphens as underscores."""
    return header.translate({0xFEFF: None}).strip().lower().translate(_FOLDED)


def syllabus_columns(headers: list[str]) -> dict[str, str]:
    """Role to header: of the headers that stand for a role, the one whose alias comes first; of equal ones the last.

    A ValueError names the roles that no header stands for.
    """
    best: dict[str, tuple[int, int, str]] = {}
    for place, header in enumerate(headers):
        role, rank = _ALIASES.get(header_key(header), (None, 0))
        if role:
            best[role] = min(best.get(role, (99, 0, "")), (rank, -place, header))
    if len(best) < len(SYLLABUS_ROLES):
        raise ValueError(f"no column of the syllabus file stands for {' or '.join(r for r in SYLLABUS_ROLES if r not in best)}; its headers are {headers}")
    return {role: best[role][2] for role in SYLLABUS_ROLES}


def syllabus_csv(spark: SparkSession, path: str) -> DataFrame:
    """(topic_code, name, syllabus_unit) of a CSV with a header; rows without one of them are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return _syllabus(rows)


def syllabus_text(spark: SparkSession, content: str) -> DataFrame:
    """The same of CSV text held in memory, as an upload gives it."""
    lines = spark.sparkContext.parallelize(content.lstrip("﻿").splitlines(), 1)
    return _syllabus(spark.read.csv(lines, header=True, escape='"'))


def _syllabus(rows: DataFrame) -> DataFrame:
    if not rows.columns:
        return rows.sparkSession.createDataFrame([], "topic_code string, name string, syllabus_unit string")
    found = syllabus_columns(rows.columns)
    out = rows.select(*(F.trim(F.col(f"`{h}`")).alias(role) for role, h in found.items()))
    return out.where("topic_code <> '' and name <> '' and syllabus_unit <> ''")


def json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of JSON files: each holds one array of objects or one object, or an object a line where ``lines`` is set."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def stored_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Page results as ``sinks.sidecars`` writes them, typed by ``schema``; what isn't a JSON object gives nulls."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def page_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, page_number, value) of JSON sidecars named <document>/<page>.json, in numerical order of pages."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("f"))
    part = lambda n: F.regexp_extract("f", r"(\d+)[/_](?:page_?)?(\d+)\.json$", n).try_cast("int")
    return files.select(part(1).alias("document_id"), part(2).alias("page_number"), "value").where("page_number is not null").orderBy("document_id", "page_number")


def database_table(spark: SparkSession, url: str, name: str, columns: tuple[str, ...] = (), **options: str) -> DataFrame:
    """A table over JDBC, with only the columns asked for; the driver must be on the class path."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return rows.select(*columns) if columns else rows


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of a SQLite file: one file, read by one task through the standard library, in batches."""
    schema = schema or DDL[name]
    columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def read(batches):
        import sqlite3

        import pandas as pd

        for batch in batches:
            for p, t in zip(batch["path"], batch["name"]):
                with sqlite3.connect(p) as db:
                    yield from pd.read_sql_query(f'SELECT {", ".join(columns)} FROM "{t}"', db, chunksize=50_000)

    if not Path(path).exists():
        raise FileNotFoundError(path)
    return spark.createDataFrame([(path, name)], "path string, name string").coalesce(1).mapInPandas(read, schema)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files such as images and PDFs."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def with_fallback(embedded: Column, scanned: Column) -> Column:
    """The text layer where there is one, else the scanned text, else an empty string."""
    return F.coalesce(F.nullif(embedded, F.lit("")), scanned, F.lit(""))
