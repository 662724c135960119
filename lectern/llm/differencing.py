"""Nearest-URL page differencing: lines that a page shares with its nearest neighbour by URL path are deleted.

Pages are sorted by host and path; each is paired with the neighbour of its host whose path shares the longer prefix with
its own. Their lines are aligned by a longest common subsequence, and what is common is taken for the page's frame.
This finds templates around content, not markup; README says what that means for markup residue.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices in ``a`` of a longest common subsequence of lines: equal pairs in order, the longest rising chain of them."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    ends: list[int] = []  # the least end in b of a chain of each length
    links: list[tuple] = []  # (index in a, the chain before)
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            at = bisect_left(ends, j)
            link = (i, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[at], links[at] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def without_shared(text: str, other: str) -> tuple[str, int]:
    """The text without the non-empty lines it shares with another, and how many those are."""
    lines, theirs = text.split("\n"), other.split("\n")
    bare = [x.strip() for x in lines]
    full = [k for k, x in enumerate(bare) if x]
    shared = {full[k] for k in common_lines([bare[k] for k in full], [x for x in map(str.strip, theirs) if x])}
    return "\n".join(x for k, x in enumerate(lines) if k not in shared), len(shared)


def differenced(pages: DataFrame) -> DataFrame:
    """(host, path, id, own_text, n_shared) of (host, path, id, text), each page against its nearest neighbour.

    A page without another of its host keeps all lines, and so do null and empty texts. Null hosts and paths count as
    empty. Pages are range-partitioned by host and path, so a host of any size is spread; a page at the edge of a
    partition takes its neighbour within. Repeated rows are pages like any other.
    """
    rows = pages.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("id").cast("long").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(before: dict | None, page: dict, after: dict | None) -> dict:
            near = [x for x in (before, after) if x and x["host"] == page["host"]]
            other = max(near, key=lambda x: len(commonprefix([x["path"], page["path"]])), default=None)
            text, n = without_shared(page["text"], other["text"] or "") if other and page["text"] else (page["text"], 0)
            return {"host": page["host"], "path": page["path"], "id": page["id"], "own_text": text, "n_shared": n}

        schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("id", pa.int64()), ("own_text", pa.string()), ("n_shared", pa.int32())])
        before = page = None
        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if page:
                    out.append(answer(before, page, after))
                before, page = page, after
            yield pa.RecordBatch.from_pylist(out, schema)
        if page:
            yield pa.RecordBatch.from_pylist([answer(before, page, None)], schema)

    return rows.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id").mapInArrow(run, "host string, path string, id long, own_text string, n_shared int")


def note_pages(notes: DataFrame, documents: DataFrame) -> DataFrame:
    """(host, path, id, text) of notes: the folder of the document's file as host, its name and the page as path."""
    files = documents.where("id is not null").groupBy("id").agg(F.min("file_path").alias("file"))
    whole = F.coalesce("file", F.concat(F.lit("documents/"), F.col("document_id").cast("string")))
    joined = notes.where("id is not null").select("id", "document_id", "page", "text").join(files.withColumnRenamed("id", "document_id"), "document_id", "left")
    return joined.select(F.regexp_extract(whole, r"^(.*/)?", 0).alias("host"), F.concat(F.regexp_replace(whole, r"^.*/", ""), F.lit("#"), F.lpad(F.coalesce(F.col("page").cast("string"), F.lit("")), 6, "0")).alias("path"), "id", "text")
