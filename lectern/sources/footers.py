"""Parquet footers, dictionary pages and single column chunks as DataFrames.

Footers are read where the tasks run, one row group and column a row. Dictionary pages are decoded from their bytes
(page headers in Thrift's compact form), so that the distinct values of a chunk are known without its data pages.
Chunks about which neither tells enough are read alone: no other row group and no other column is opened.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Dictionaries of more bytes than this are not sent on; their chunk counts as not described.
MAX_DICTIONARY_BYTES = 1 << 20

#: Names that Hadoop gives to file systems which pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "maprfs": "hdfs"}

SCHEMA = "path string, row_group int, column_name string, n_rows long, n_nulls long, min_value string, max_value string, complete boolean, items array<string>"


def compact_struct(data: bytes, at: int) -> tuple[dict[int, object], int]:
    """Read one Thrift compact struct; returns its fields by id, and the position behind it."""

    def varint(i: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[i]
            value |= (byte & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if byte < 0x80:
                return value, i

    def read(kind: int, i: int) -> tuple[object, int]:
        if kind in (1, 2):
            return kind == 1, i
        if kind == 3:
            return data[i], i + 1
        if kind in (4, 5, 6):
            n, i = varint(i)
            return (n >> 1) ^ -(n & 1), i
        if kind == 7:
            return struct.unpack_from("<d", data, i)[0], i + 8
        if kind == 8:
            n, i = varint(i)
            return data[i : i + n], i + n
        if kind in (9, 10):
            head, i = data[i], i + 1
            n, sort = head >> 4, head & 15
            if n == 15:
                n, i = varint(i)
            out = []
            for _ in range(n):
                x, i = read(sort, i) if sort not in (1, 2) else (data[i] == 1, i + 1)
                out.append(x)
            return out, i
        if kind == 12:
            return compact_struct(data, i)
        raise ValueError(f"Thrift type {kind}")

    fields: dict[int, object] = {}
    last = 0
    while True:
        head, at = data[at], at + 1
        if not head:
            return fields, at
        if head >> 4:
            last += head >> 4
        else:
            n, at = varint(at)
            last = (n >> 1) ^ -(n & 1)
        fields[last], at = read(head & 15, at)


def plain_values(kind: str, data: bytes, n: int) -> list | None:
    """Values of a PLAIN dictionary page, or None where the physical type isn't handled."""
    number = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}.get(kind)
    if number:
        return np.frombuffer(data, number, n).tolist()
    if kind != "BYTE_ARRAY":
        return None
    out, at = [], 0
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at += 4 + size
    return out


def chunk_dictionary(source: pa.NativeFile, column: pq.ColumnChunkMetaData) -> tuple[list | None, bool]:
    """The chunk's dictionary, and whether every data page is coded by it."""
    if not column.has_dictionary_page or column.dictionary_page_offset is None:
        return None, False
    at, end, items, complete, seen = column.dictionary_page_offset, column.dictionary_page_offset + column.total_compressed_size, None, True, 0
    while at < end and seen < column.num_values:
        source.seek(at)
        head = source.read(min(4096, end - at))
        page, size = compact_struct(head, 0)
        if page[1] == 2:
            if page[2] > MAX_DICTIONARY_BYTES:
                return None, False
            body = head[size : size + page[3]]
            if len(body) < page[3]:
                source.seek(at + size)
                body = source.read(page[3])
            codec = column.compression.lower()
            if codec != "uncompressed":
                body = pa.decompress(body, decompressed_size=page[2], codec=codec, asbytes=True)
            items = plain_values(column.physical_type, body, page[7][1])
        elif page[1] in (0, 3):
            head = page[5] if page[1] == 0 else page[8]
            seen += head[1]
            complete &= head[2 if page[1] == 0 else 4] in (2, 8)
        at += size + page[3]
    return items, complete and items is not None and seen >= column.num_values


def _text(value: object) -> str | None:
    if value is None:
        return None
    if hasattr(value, "timestamp"):
        return str(int(np.datetime64(value, "us").astype("int64")))
    return str(value).lower() if isinstance(value, bool) else str(value)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it (plain, or a URI by Hadoop's or pyarrow's name of the system), and the
    path in its terms."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def opened(path: str) -> pa.NativeFile:
    """The file behind a path, for reading."""
    system, inner = located(path)
    return system.open_input_file(inner)


def spread(spark: SparkSession, files: int) -> int:
    """Partitions for work on the chunks of so many files: set by number, as rows that name chunks are too small to tell."""
    return max(1, min(4 * files, max(4 * spark.sparkContext.defaultParallelism, files // 4)))


def read_chunks(chunks: DataFrame, extra: list[str], answer: Callable[[dict, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """For each row of ``chunks`` (path, row_group, column_name, ...) what ``answer`` makes of that chunk alone, read
    together with the columns ``extra`` of the same row group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    yield answer(row, pq.ParquetFile(source).read_row_group(row["row_group"], columns=[*dict.fromkeys([*extra, row["column_name"]])], use_threads=False))

    return chunks.mapInArrow(run, schema)


def footers(spark: SparkSession, paths: list[str], columns: list[str], dictionaries: list[str]) -> DataFrame:
    """A row for each file, row group and column: rows, exact nulls and extrema where the footer has them, and for
    ``dictionaries`` the decoded dictionary with whether it covers the chunk. Missing statistics are null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with opened(path) as source:
                    meta = pq.ParquetFile(source).metadata
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            column = group.column(c)
                            name = column.path_in_schema
                            if name not in columns:
                                continue
                            stats = column.statistics if column.is_stats_set else None
                            exact = stats is not None and stats.has_min_max and getattr(stats, "is_min_value_exact", True) is not False and getattr(stats, "is_max_value_exact", True) is not False
                            items, complete = chunk_dictionary(source, column) if name in dictionaries else (None, False)
                            rows.append((path, g, name, group.num_rows, stats.null_count if stats is not None and stats.has_null_count else None, _text(stats.min) if exact else None, _text(stats.max) if exact else None, complete, None if items is None else [_text(x) for x in items]))
                yield pd.DataFrame(rows, columns=["path", "row_group", "column_name", "n_rows", "n_nulls", "min_value", "max_value", "complete", "items"]).astype({"row_group": "int32", "n_nulls": "Int64"})

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(read, SCHEMA)
