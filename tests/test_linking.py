from __future__ import annotations

import numpy as np
import pytest

from lectern.operators import linking
from lectern.scale import dense_ids, skew_safe_join


def vectors(spark, n=60, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 3 if i % 7 else 0, [float(x) for x in rng.normal(size=dims)], "x") for i in range(n)]
    return rows, spark.createDataFrame(rows + [(900, 1, None, "x"), (None, 1, rows[0][2], "x"), (901, None, rows[0][2], "x"), (902, 1, [0.0] * dims, "x")], "id long, topic_id long, vector array<double>, n string")


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("block", [4096, 2])
def test_topics(spark, monkeypatch, block):
    monkeypatch.setattr(linking, "TOPIC_BLOCK", block)
    rows, items = vectors(spark)
    topics = [(10, rows[0][2]), (11, rows[1][2]), (12, rows[0][2]), (13, None), (14, rows[2][2]), (15, rows[3][2])]
    df = linking.assign_topics(items.drop("topic_id"), spark.createDataFrame(topics, "id int, vector array<double>"), 0.4)
    live = [(k, v) for k, v in topics if v is not None]
    want = {}
    for i, _, v, _ in rows:
        score, best = max((round(cosine(v, t), 9), -k) for k, t in live)
        if score >= 0.4:
            want[i] = -best
    assert {r["id"]: r["topic_id"] for r in df.collect() if r["id"] < 900} == want
    assert linking.assign_topics(items, spark.createDataFrame([], "id int, vector array<double>")).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_pairs_and_groups(spark, block):
    rows, items = vectors(spark)
    pairs = linking.repeat_pairs(items, 0.4, block)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cosine(a[2], b[2]) >= 0.4}
    got = [(r["left"], r["right"]) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    groups = linking.repeat_groups(items.where("id is not null and topic_id is not null"), pairs, 5).collect()
    assert {r["id"] for r in groups} == {x for p in want for x in p}
    assert sorted({r["repeat_group_id"] for r in groups}) == list(range(6, 6 + len({r["repeat_group_id"] for r in groups})))
    of = {r["id"]: r["repeat_group_id"] for r in groups}
    assert all(of[a] == of[b] for a, b in want)
    assert linking.repeat_pairs(items.where("false"), 0.4).count() == 0


@pytest.mark.parametrize("one_task", [1_000_000, 3, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("lectern.scale.HOT_ROWS", 1)
    rng = np.random.default_rng(one_task)
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3), (3, None)] + [(i, 200) for i in range(201, 260)] + [tuple(int(x) for x in rng.integers(300, 360, 2)) for _ in range(40)]
    df = spark.createDataFrame([(*p, 1) for p in pairs], "left long, right long, root long")
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in ((a, b) for a, b in pairs if a in root and b in root and a != b):
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = [tuple(r) for r in linking.components(df, one_task).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert linking.components(df.where("false"), one_task).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None), (4, None, "z"), (5, None, "w")], "id int, text string, source string")
    assert sorted(map(tuple, linking.keep_first(df, "id", "text").collect()), key=str) == [(1, "a", "y"), (2, "b", None), (4, None, "z")]


def test_dense_ids(spark):
    df = spark.range(500).selectExpr("id % 101 as a", "id % 3 as b").repartition(7)
    rows = sorted(dense_ids(df, ["a", "b"], "n", 10).collect(), key=lambda r: (r["a"], r["b"]))
    assert [r["n"] for r in rows] == list(range(10, 10 + len(rows))) and len(rows) == 303


def test_skew_safe_join_takes_both_ways(spark, monkeypatch):
    monkeypatch.setattr("lectern.scale.HOT_ROWS", 1)
    big = spark.range(1000).selectExpr("case when id % 3 = 0 then 7 else id end as k", "id as v")
    small = spark.range(0, 900).selectExpr("id as k", "id * 2 as w")
    want = big.join(small, "k")
    assert sorted(map(tuple, skew_safe_join(big, "k", small, 1000).collect())) == sorted(map(tuple, want.collect()))
