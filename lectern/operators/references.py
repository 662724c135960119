"""References to records that do not exist.

Keys are cut into ranges at approximate quantiles. Each range holds its parents as sorted arrays, and the
references of the range are probed against them in vectorised batches by binary search. A range whose references
are too many (one hot key is enough) is split: its references are spread over several parts by a hash of the row
key and the parents of that range, which are few, are repeated for each part. Nothing is broadcast but the range
bounds, whose number is limited by MAX_RANGES.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of parents and references a range aims at, references in one part of it, and the most ranges of one field.
RANGE_ROWS, PART_ROWS, MAX_RANGES = 2_000_000, 1_000_000, 16_384

FOUND = "ref_field string, row_key string, kind string, created_at timestamp_ntz"


@dataclass(frozen=True)
class Reference:
    """A referring column: its rows, key column, row key, creation time, and the parents it points to."""

    name: str
    children: DataFrame
    key: str
    row_key: Column
    parents: DataFrame
    entity: str
    created: str = "created_at"
    parent_id: str = "id"
    parent_created: str = "created_at"


def _children(refs: list[Reference]) -> DataFrame:
    parts = [
        r.children.where(F.col(r.key).isNotNull()).select(
            F.lit(i).alias("f"), F.col(r.key).cast("long").alias("k"), r.row_key.cast("string").alias("rk"), F.col(r.created).cast("timestamp_ntz").alias("ts")
        )
        for i, r in enumerate(refs)
    ]
    return _union(parts)


def _parents(refs: list[Reference], deleted: DataFrame) -> DataFrame:
    """Living parents with their creation time, deleted ones with a mark; (f, k, ts, gone)."""
    gone = F.broadcast(deleted.sparkSession.createDataFrame([(i, r.entity) for i, r in enumerate(refs)], "f int, entity string"))
    logged = deleted.where(F.col("record_id").isNotNull()).select("entity", F.col("record_id").cast("long").alias("k")).join(gone, "entity")
    parts = [
        r.parents.where(F.col(r.parent_id).isNotNull()).select(
            F.lit(i).alias("f"), F.col(r.parent_id).cast("long").alias("k"), F.col(r.parent_created).cast("timestamp_ntz").alias("ts"), F.lit(False).alias("gone")
        )
        for i, r in enumerate(refs)
    ]
    return _union(parts + [logged.select("f", "k", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(True).alias("gone"))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bounds(children: DataFrame, parents: DataFrame, n_fields: int, range_rows: int) -> list[np.ndarray]:
    """Ascending upper bounds of the ranges of each field, at quantiles of all its keys."""
    keys = children.select("f", "k").unionByName(parents.select("f", "k"))
    rows = {r["f"]: r["n"] for r in keys.groupBy("f").agg(F.count("*").alias("n")).collect()}
    out = [np.array([], dtype=np.int64)] * n_fields
    wanted = {f: min(MAX_RANGES, -(-n // range_rows)) for f, n in rows.items()}
    for n in sorted({n for n in wanted.values() if n > 1}):
        cuts = [(i + 1) / n for i in range(n - 1)]
        found = keys.where(F.col("f").isin([f for f, m in wanted.items() if m == n])).groupBy("f").agg(F.percentile_approx("k", cuts, 10 * n).alias("q"))
        for r in found.collect():
            out[r["f"]] = np.unique(np.array(r["q"], dtype=np.int64))
    return out


def orphan_references(refs: list[Reference], deleted: DataFrame, range_rows: int = RANGE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Each reference whose record is absent or younger: (ref_field, row_key, kind, created_at), without duplicates.

    kind is ``deleted`` (absent, and in the deletion log under that entity), ``missing`` (absent otherwise) or
    ``late`` (present, created after the referring row). Null keys are no references. A null creation time on either
    side is never late. Of parents with one id the earliest creation counts. A log entry of a record that exists
    (restored) is ignored. Rows delivered several times give one row per kind, dated by their earliest creation.
    Empty tables: without references the result is empty, without parents every reference is absent.
    """
    names = [r.name for r in refs]
    children, parents = _children(refs), _parents(refs, deleted)
    bounds = _bounds(children, parents, len(refs), range_rows)
    first = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bounds])])

    def ranges(f: pd.Series, k: pd.Series) -> np.ndarray:
        fs, ks, out = f.to_numpy(), k.to_numpy(), np.zeros(len(f), dtype=np.int64)
        for i in np.unique(fs):
            at = fs == i
            out[at] = first[i] + np.searchsorted(bounds[i], ks[at], side="left")
        return out

    if first[-1] == len(refs):  # one range a field: no need to leave the JVM
        range_of = lambda: F.col("f").cast("long")
    else:
        udf = F.pandas_udf(lambda f, k: pd.Series(ranges(f, k)), "long")
        range_of = lambda: udf("f", "k")

    counts = {r["r"]: r["n"] for r in children.select(range_of().alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()}
    splits = [max(1, -(-counts.get(r, 0) // part_rows)) for r in range(int(first[-1]))]
    base = np.concatenate([[0], np.cumsum(splits)])
    if max(splits, default=1) == 1:
        child_parts = children.withColumn("part", range_of())
        parent_parts = parents.withColumn("part", range_of())
    else:
        spark = children.sparkSession
        ways = F.broadcast(spark.createDataFrame([(r, int(base[r]), s) for r, s in enumerate(splits)], "r long, base long, ways int"))
        child_parts = children.withColumn("r", range_of()).join(ways, "r").withColumn("part", F.col("base") + F.pmod(F.xxhash64("rk"), F.col("ways"))).drop("r", "base", "ways")
        parent_parts = parents.withColumn("r", range_of()).join(ways, "r").withColumn("part", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("ways") - 1))).drop("r", "base", "ways")

    def probe(child: pa.Table, parent: pa.Table) -> pa.Table:
        ck, cf = child["k"].to_numpy(), child["f"].to_numpy()
        pk, pf = parent["k"].to_numpy(), parent["f"].to_numpy()
        cts = child["ts"].cast(pa.int64()).to_numpy() if child["ts"].null_count == 0 else child["ts"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
        gone = parent["gone"].to_numpy().astype(bool)
        born = parent["ts"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        miss, late, dead = (np.zeros(len(ck), dtype=bool) for _ in range(3))
        for f in np.unique(cf):
            at = np.flatnonzero(cf == f)
            alive = np.flatnonzero((pf == f) & ~gone)
            alive = alive[np.lexsort((born[alive], pk[alive]))]
            here, seen = _search(pk[alive], ck[at])
            miss[at] = ~seen
            late[at[seen]] = born[alive][here[seen]] > cts[at[seen]]
            dead[at] = ~seen & _search(np.sort(pk[(pf == f) & gone]), ck[at])[1]
        hit = np.flatnonzero(miss | late)
        kind = np.where(dead[hit], "deleted", np.where(miss[hit], "missing", "late"))
        found = child.take(pa.array(hit))
        table = pa.table({"ref_field": pa.array([names[i] for i in found["f"].to_pylist()], pa.string()), "row_key": found["rk"].cast(pa.string()), "kind": pa.array(kind, pa.string()), "created_at": found["ts"].cast(pa.timestamp("us"))})
        return table.group_by(["ref_field", "row_key", "kind"]).aggregate([("created_at", "min")]).rename_columns(["ref_field", "row_key", "kind", "created_at"])

    return child_parts.groupBy("part").cogroup(parent_parts.groupBy("part")).applyInArrow(probe, FOUND)


def _search(keys: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each probe's first equal key in a sorted array, and whether there is one."""
    if not len(keys):
        return np.zeros(len(probes), dtype=np.int64), np.zeros(len(probes), dtype=bool)
    at = np.minimum(np.searchsorted(keys, probes, side="left"), len(keys) - 1)
    return at, keys[at] == probes


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Number of orphan references per referring field, kind, and month in which the referring row was created."""
    return found.groupBy("ref_field", F.date_format("created_at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n_refs"))
