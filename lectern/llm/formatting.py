"""Duplicates hidden by formatting: equal bare text and equal marks.

The UTF-8 bytes of a column are streamed in windows through a table that skips what is neither letter nor digit and
folds letter case; each code goes straight into two polynomial hashes at the rank it has among the kept ones, so no
canonical string is built. Rows of one hash are verified against their keeper by two pointers that skip through both
texts; all rows of a batch take their steps together. Rows that collide without being equal are told apart exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scale import cut, release, skew_safe_join

#: Odd multipliers of the two hashes, fixed values.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes a window takes at a time, and parts over which the copies of a hot set are spread.
CHUNK, SALTS = 1 << 20, 64
#: Rows from which the two pointers take steps together; fewer go row by row, whole runs of kept codes at a time.
STEP_ROWS = 16

_TABLE: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point 0 where it is skipped, else the code of its lower-case form."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            if 0xD800 <= code < 0xE000:
                continue
            char = chr(code)
            if char.isalnum():
                table[code] = ord(next(c for c in char.lower() if c.isalnum()))
        _TABLE.append(table)
    return _TABLE[0]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n-1 of both bases, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in BASES]
    return _POWERS


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, uncopied, and where each row begins (one more for the end). Nulls are empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32, len(column) + 1, column.offset * (8 if pa.types.is_large_string(column.type) else 4)).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), starts


def folded(data: np.ndarray) -> np.ndarray:
    """For each byte the folded code of the character that begins there, 0 where it is skipped or none begins."""
    table = fold_table()
    if not len(data) or data.max() < 0x80:
        return table[data]
    out = np.zeros(len(data), dtype=np.uint32)
    plain = data < 0x80
    out[plain] = table[data[plain]]
    for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        code = (data[at] & bits).astype(np.uint32)
        for k in range(1, more + 1):
            code = code << np.uint32(6) | data[np.minimum(at + k, len(data) - 1)] & np.uint32(0x3F)
        out[at] = table[np.minimum(code, 0x10FFFF)]
    return out


def bare_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit hashes of the bare form of each row: the sum of each kept code times the power of its rank."""
    data, starts = utf8_bytes(column)
    n = len(starts) - 1
    out, ranks = np.zeros((2, n), dtype=np.uint64), np.zeros(n, dtype=np.int64)
    begin, stop = (int(starts[0]), int(starts[-1])) if n else (0, 0)
    while begin < stop:
        end = min(begin + CHUNK, stop)
        while end < stop and data[end] & 0xC0 == 0x80:  # windows end between characters
            end += 1
        codes = folded(data[begin:end])
        seen = np.cumsum(codes != 0)
        rows = np.arange(np.searchsorted(starts, begin, side="right") - 1, np.searchsorted(starts, end, side="left"))
        rows = rows[np.maximum(starts[rows], begin) < np.minimum(starts[rows + 1], end)]  # those with a byte here
        first = np.maximum(starts[rows], begin) - begin
        held = np.where(first > 0, seen[first - 1], 0)
        rank = np.maximum(seen - np.repeat(held, np.diff(np.append(first, end - begin))) - 1, 0)  # of skipped bytes: any, as their code is 0
        table = powers(int(rank.max()) + 1)
        values = np.where(codes != 0, codes.astype(np.uint64) + np.uint64(1), np.uint64(0))
        for k in range(2):
            part = np.add.reduceat(values * table[k][rank], first)
            if ranks[rows[0]]:  # only the first row may have begun in an earlier window
                part[:1] *= np.uint64(pow(BASES[k], int(ranks[rows[0]]), 1 << 64))
            out[k, rows] += part
        ranks[rows] += np.diff(np.append(held, seen[-1]))
        begin = end
    for k in range(2):
        h = out[k] + ranks.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out[k] = h * np.uint64(BASES[1 - k])
    return out[0], out[1]


def _next_kept(codes: np.ndarray) -> np.ndarray:
    """For each position the first kept one from there on, the length where there is none; one more for the end."""
    at = np.where(codes != 0, np.arange(len(codes)), len(codes))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], len(codes))


def same_bare(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether the two texts of each row have the same bare form, by two pointers that skip what doesn't count.

    The pointers of all rows move in step; the last few rows, with long texts, move by whole runs of kept codes.
    """
    same = np.zeros(len(left), dtype=bool)
    if not len(left):
        return same
    (a, a_starts), (b, b_starts) = utf8_bytes(left), utf8_bytes(right)
    a, b = folded(a[: a_starts[-1]]), folded(b[: b_starts[-1]])
    next_a, next_b = _next_kept(a), _next_kept(b)
    row, i, j = np.arange(len(left)), next_a[a_starts[:-1]], next_b[b_starts[:-1]]
    while len(row) >= STEP_ROWS:
        a_done, b_done = i >= a_starts[row + 1], j >= b_starts[row + 1]
        same[row[a_done & b_done]] = True
        going = ~(a_done | b_done)
        row, i, j = row[going], i[going], j[going]
        going = a[i] == b[j]
        row, i, j = row[going], next_a[i[going] + 1], next_b[j[going] + 1]
    if len(row):
        run_a, run_b = _next_kept(a == 0), _next_kept(b == 0)
        for r, x, y in zip(row.tolist(), i.tolist(), j.tolist()):
            a_end, b_end = a_starts[r + 1], b_starts[r + 1]
            while x < a_end and y < b_end:
                n = min(run_a[x] - x, run_b[y] - y, a_end - x, b_end - y)
                if not np.array_equal(a[x : x + n], b[y : y + n]):
                    break
                x, y = next_a[x + n], next_b[y + n]
            else:
                same[r] = x >= a_end and y >= b_end
    return same


def hashed(rows: DataFrame, bits: int = 64) -> DataFrame:
    """(source_table, id, h1, h2, marks) of (source_table, id, text, marks). ``bits`` below 64 weakens the hashes, for tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = bare_hashes(b["text"])
            if bits < 64:
                h1, h2 = h1 >> np.uint64(64 - bits), h2 * np.uint64(0)
            yield pa.RecordBatch.from_arrays([b["source_table"], b["id"], pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), b["marks"]], names=["source_table", "id", "h1", "h2", "marks"])

    return rows.mapInArrow(run, "source_table string, id long, h1 long, h2 long, marks string")


def format_copies(rows: DataFrame, bits: int = 64) -> DataFrame:
    """(source_table, keep_id, copy_id) over rows (source_table, id, text, marks).

    Records of one source with equal bare text and equal marks form a set; its smallest id is kept and each other id
    gives a row. ``marks`` is a canonical string of the number. Null marks equal null. A null text counts as empty,
    and all texts without letters or digits are equal. A repeated id counts once. Hot sets of copies are met by
    broadcasts of a bounded number of keepers.
    """
    parts = ["source_table", "h1", "h2", F.coalesce("marks", F.lit("?null")).alias("m")]
    keyed = cut(hashed(rows, bits).select(F.xxhash64("source_table", "h1", "h2", "marks").alias("key"), *parts, "id"))
    sets = keyed.groupBy("key", "source_table", "h1", "h2", "m").agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id")).where("last_id > keep_id")
    sets = cut(sets.toDF("key", "s", "k1", "k2", "n", "keep_id", "last_id"))
    # joined by one number, so that hot sets are found and broadcast by it; then by all parts of the key
    met = skew_safe_join(keyed, "key", sets, keyed.count()).where("source_table = s and h1 = k1 and h2 = k2 and m = n and id <> keep_id")
    pairs = cut(met.select(F.col("source_table").alias("src"), "keep_id", F.col("id").alias("copy_id")).distinct())
    n_pairs = pairs.count()

    # the copies of a hot set are spread over SALTS parts, each of which gets the keeper's text
    hot = F.broadcast(pairs.groupBy("src", "keep_id").count().where(F.col("count") * 256 >= max(n_pairs, 256)).select("src", "keep_id", F.lit(True).alias("hot")))  # at most 256 rows
    texts = rows.select(F.col("source_table").alias("src"), "id", F.coalesce("text", F.lit("")).alias("text"))
    salted = pairs.join(hot, ["src", "keep_id"], "left").select("src", "keep_id", "copy_id", F.when(F.col("hot"), F.pmod(F.xxhash64("copy_id"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    keepers = pairs.select("src", "keep_id").distinct().join(hot, ["src", "keep_id"], "left")
    keepers = keepers.select("src", "keep_id", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    with_copy = salted.join(texts.select("src", F.col("id").alias("copy_id"), F.col("text").alias("copy_text")), ["src", "copy_id"])
    keep_text = keepers.join(texts.select("src", F.col("id").alias("keep_id"), F.col("text").alias("keep_text")), ["src", "keep_id"])
    both = with_copy.join(keep_text, ["src", "keep_id", "salt"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = same_bare(b["copy_text"], b["keep_text"])
            yield pa.RecordBatch.from_arrays([b["src"], b["keep_id"], b["copy_id"], pa.array(same)], names=["source_table", "keep_id", "copy_id", "same"])

    checked = cut(both.select("src", "keep_id", "copy_id", "copy_text", "keep_text").mapInArrow(check, "source_table string, keep_id long, copy_id long, same boolean"))
    for done in (keyed, sets, pairs):
        release(done)
    good = checked.where("same").select("source_table", "keep_id", "copy_id").distinct()
    if checked.where("not same").isEmpty():
        return good
    return good.unionByName(_told_apart(rows, checked.where("not same").select("source_table", F.col("copy_id").alias("id"))))


def _told_apart(rows: DataFrame, strays: DataFrame) -> DataFrame:
    """Exact sets among rows whose hash met that of a keeper they don't equal."""
    bare = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]", "")
    rest = rows.join(strays, ["source_table", "id"], "left_semi").select("source_table", "id", "marks", bare.alias("bare"))
    keys = ["source_table", "bare", F.coalesce("marks", F.lit("?null")).alias("m")]
    sets = rest.groupBy(*keys).agg(F.min("id").alias("keep_id"))
    return rest.select(*keys, "id").join(sets, ["source_table", "bare", "m"]).where("id <> keep_id").select("source_table", "keep_id", F.col("id").alias("copy_id")).distinct()


def number_text(value: object) -> str | None:
    """Canonical text of a mark given as a number or as a string holding one; anything else stands for itself."""
    if value is None or isinstance(value, bool):
        return None if value is None else str(value)
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return f"?{value}"
    if not number.is_finite():
        return f"?{value}"
    return format(number.normalize() + 0, "f")


def parsed_imports(imports: DataFrame) -> DataFrame:
    """(source_table, id, text, marks) of raw JSON payloads; payloads that aren't JSON objects are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, marks = [], [], []
            for i, payload in zip(b["import_id"].to_pylist(), b["payload"].to_pylist()):
                try:
                    record = json.loads(payload)
                except (TypeError, ValueError):
                    continue
                if isinstance(record, dict) and i is not None:
                    text = record.get("raw_text")
                    ids.append(i)
                    texts.append(text if isinstance(text, str) else None if text is None else json.dumps(text))
                    marks.append(number_text(record.get("marks")))
            yield pa.RecordBatch.from_arrays([pa.array(["question_imports"] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, pa.string())], names=["source_table", "id", "text", "marks"])

    return imports.select("import_id", "payload").mapInArrow(run, "source_table string, id long, text string, marks string")


def stored_questions(questions: DataFrame) -> DataFrame:
    """The same columns of the questions table."""
    return questions.where(F.col("id").isNotNull()).select(F.lit("questions").alias("source_table"), F.col("id").cast("long").alias("id"), "text", F.col("marks").cast("string").alias("marks"))


def collapsed(rows: DataFrame) -> DataFrame:
    """(source_table, keep_id, n_copies): one record of each set with its number of copies, itself included."""
    copies = format_copies(rows)
    sizes = copies.groupBy("source_table", "keep_id").agg((F.count("*") + 1).alias("n_copies"))
    single = rows.select("source_table", F.col("id").alias("keep_id")).distinct().join(copies.select("source_table", F.col("copy_id").alias("keep_id")), ["source_table", "keep_id"], "left_anti")
    return single.join(sizes, ["source_table", "keep_id"], "left").select("source_table", "keep_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


