from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators.references import Reference, orphan_references, orphans_by_month

T0, T1, T2 = datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5)
CHILD = "id int, parent int, created_at timestamp_ntz, kind string, part long, f int, gone string"
PARENT = "id int, created_at timestamp_ntz, ts string"
DELETED = "entity string, record_id int, deleted_at timestamp_ntz"


def found(spark, children, parents, deleted, **how):
    c = spark.createDataFrame([(i, p, t, "x", 1, 2, "y") for i, p, t in children], CHILD)
    ref = Reference("c.parent", c, "parent", F.col("id"), spark.createDataFrame([(i, t, "z") for i, t in parents], PARENT), "parents")
    return orphan_references([ref], spark.createDataFrame(deleted, DELETED), **how)


def plain(df):
    return sorted((r["row_key"], r["kind"]) for r in df.collect())


def test_kinds_nulls_and_clashing_columns(spark):
    children = [(1, 10, T1), (2, 11, T1), (3, 12, T1), (4, 13, T0), (5, None, T1), (6, 10, None), (7, 14, T1), (8, 13, T2)]
    parents = [(10, T0), (13, T1), (14, None), (None, T0)]
    deleted = [("parents", 11, T2), ("parents", 11, T2), ("other", 12, T2), ("parents", 10, T2), (None, 12, T2)]
    assert plain(found(spark, children, parents, deleted)) == [("2", "deleted"), ("3", "missing"), ("4", "late")]


def test_repeated_rows_and_parents_count_once(spark):
    children = [(1, 10, T0), (1, 10, T0), (2, 99, T0), (2, 99, T1)]
    assert plain(found(spark, children, [(10, T1), (10, T2)], [])) == [("1", "late"), ("2", "missing")]
    assert plain(found(spark, children, [(10, T1), (10, T0)], [])) == [("2", "missing")]


def test_empty_tables(spark):
    assert plain(found(spark, [], [(1, T0)], [])) == []
    assert plain(found(spark, [(1, 5, T0)], [], [])) == [("1", "missing")]


@pytest.mark.parametrize("range_rows,part_rows", [(10, 5), (40, 7), (1000, 1000)])
def test_ranges_and_splits_agree_with_brute_force(spark, range_rows, part_rows):
    import random

    rng = random.Random(range_rows)
    parents = [(i * 3 - 60, rng.choice([T0, T1, T2])) for i in range(60)]
    children = [(i, rng.choice([0, 0, 0, rng.randrange(-80, 140)]), rng.choice([T0, T1, T2])) for i in range(300)]
    deleted = [("parents", k, T2) for k in range(-80, 140, 5)]
    born, gone = dict(parents), {k for _, k, _ in deleted}
    want = sorted((str(i), "deleted" if p not in born and p in gone else "missing" if p not in born else "late") for i, p, t in children if p not in born or born[p] > t)
    assert plain(found(spark, children, parents, deleted, range_rows=range_rows, part_rows=part_rows)) == want


def test_months(spark):
    df = orphans_by_month(found(spark, [(1, 5, T0), (2, 6, T0), (3, 5, T1)], [], []))
    assert sorted(map(tuple, df.collect())) == [("c.parent", "2024-01", "missing", 2), ("c.parent", "2024-02", "missing", 1)]
