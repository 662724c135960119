"""Seams for kernels that aren't relational: a given function runs over rows in batches, and failures stay rows.

PDF text, scanning, image operations, formula recognition, rendering and text generation need libraries or services that
a caller brings along. A kernel gets one record as a dict and gives one dict, or a list of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_kernel(rows: DataFrame, kernel: Callable[[dict], dict | list[dict]], schema: str, keys: tuple[str, ...], retries: int = 0) -> DataFrame:
    """``kernel`` over every row: the keys, the columns of ``schema``, and ``error`` (null where all went well).

    A row whose kernel fails ``retries`` + 1 times has nulls and the error's text, so one bad page never ends a job.
    """
    fields = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema.fields]
    kept = [f"`{k}` {dict(rows.dtypes)[k]}" for k in keys]

    def apply(record: dict) -> list[dict]:
        error = ""
        for _ in range(retries + 1):
            try:
                found = kernel(record)
                return found if isinstance(found, list) else [found]
            except Exception as e:  # noqa: BLE001 - whatever a foreign kernel raises
                error = f"{type(e).__name__}: {e}"
        return [{"error": error}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = batch.astype(object).where(batch.notna(), None).to_dict("records")
            out = [{**{k: r[k] for k in keys}, **dict.fromkeys(fields), "error": None, **x} for r in records for x in apply(r)]
            yield pd.DataFrame(out, columns=[*keys, *fields, "error"])

    return rows.mapInPandas(run, ", ".join([*kept, schema, "error string"]))


def pdf_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_number, embedded_text, error) of binary files; ``reader`` gives the text of each page."""
    kernel = lambda r: [{"page_number": i + 1, "embedded_text": t} for i, t in enumerate(reader(bytes(r["content"])))]
    return run_kernel(files.select("path", "content"), kernel, "page_number int, embedded_text string", ("path",))


def scanned_text(pages: DataFrame, scanner: Callable[[dict], str], least: int = 20) -> DataFrame:
    """Pages with ``ocr_text`` from the scanner, which only sees pages without a usable text layer."""
    from lectern.functions.text import usable

    need = pages.where(~usable(F.col("embedded_text"), least))
    keys = ("document_id", "page_number")
    read = run_kernel(need, lambda r: {"ocr_text": scanner(r)}, "ocr_text string", keys).select(*keys, F.coalesce("ocr_text", F.lit("")).alias("ocr_text"))
    return pages.drop("ocr_text").join(read, list(keys), "left")


def structured_notes(notes: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """(id, structured_content, error) of notes with a text; one retry, and an empty answer is an error."""

    def kernel(record: dict) -> dict:
        answer = generate(record["text"])
        if not answer or not answer.strip():
            raise ValueError("empty answer")
        return {"structured_content": answer.strip()}

    return run_kernel(notes.where("text <> ''").select("id", "text"), kernel, "structured_content string", ("id",), retries=1)


def embedded(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "linked_text") -> DataFrame:
    """(id, vector): the texts of a whole batch go to the encoder at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "vector": [list(map(float, v)) for v in encode(batch[text].tolist())]})

    return rows.select(F.col("id").cast("long").alias("id"), text).mapInPandas(run, "id long, vector array<double>")
