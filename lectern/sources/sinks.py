"""Writers of result tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.footers import located


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Add rows to a Parquet table."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """A new version of a table. ``rows`` must not read ``path``."""
    rows.write.mode("overwrite").parquet(path)


def questions_by_year(rows: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Questions partitioned by year, so that queries of a year read that year alone. A year of many rows is spread over
    as many tasks and files as ``file_rows`` asks for."""
    sizes = rows.groupBy("year").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_files"))  # one row a year
    salted = rows.join(F.broadcast(sizes), rows["year"].eqNullSafe(sizes["year"])).drop(sizes["year"]).withColumn("_salt", F.pmod(F.xxhash64("document_id", "page"), F.col("_files")))
    salted.repartition("year", "_salt").sortWithinPartitions("document_id", "page").drop("_files", "_salt").write.mode("overwrite").partitionBy("year").parquet(path)


def csv_file(rows: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def json_document(path: str, **tables: DataFrame) -> None:
    """One JSON document of result tables, such as a coverage report or a plan, by name. Rows are streamed to the file, a
    partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for k, (name, df) in enumerate(tables.items()):
            out.write(f"{',' * bool(k)}\n  {json.dumps(name, ensure_ascii=False)}: [")
            rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator()
            for n, r in enumerate(rows):
                out.write(f"{',' * bool(n)}\n    {r['value']}")
            out.write("]")
        out.write("\n}\n")


def sidecars(pages: DataFrame, path: str) -> None:
    """Page results as JSON (value), in a folder per document."""
    pages.select("document_id", F.to_json(F.struct(*pages.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("document_id").text(path)


def markdown_document(parts: DataFrame, path: str, title: str) -> None:
    """The Markdown export of one document: its parts in order of page and note, behind a title."""
    rows = parts.orderBy("page", "note_id").select("markdown")
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"# {title}\n\n")
        for r in rows.toLocalIterator():  # one document, streamed
            out.write(r["markdown"])


def anki_deck(rows: DataFrame, path: str) -> None:
    """Cards as CSV with the columns Front, Back and Tags."""
    csv_file(rows.select(F.col("front").alias("Front"), F.col("back").alias("Back"), F.col("tags").alias("Tags")), path)


def document_files(rows: DataFrame, folder: str, suffix: str = ".pdf") -> int:
    """One file for each row (document_id, content), named by its document, in a folder that all executors share; the
    number of files. A task that runs again writes the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = located(folder)
        system.create_dir(inner, recursive=True)
        for b in batches:
            for document, content in zip(b["document_id"], b["content"]):
                with system.open_output_stream(f"{inner}/{document}{suffix}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    return rows.select("document_id", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
