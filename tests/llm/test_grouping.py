from __future__ import annotations

import random

import pytest

from lectern.llm.grouping import connected_groups, question_groups


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((x, find(x)) for x in root)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "left int, right int")


CHAIN = [(i, i + 1) for i in range(300)]
STAR = [(1000, i) for i in range(300)]


@pytest.mark.parametrize("pairs", [CHAIN, CHAIN[::-1], STAR, [(b, a) for a, b in STAR], [(5, 5), (None, 3), (3, None), (1, 2), (2, 1), (1, 2)], [(-5, -3), (-3, 7), (2**31 - 1, -(2**31))]])
def test_shapes(spark, pairs):
    assert sorted(map(tuple, connected_groups(links(spark, pairs)).collect())) == brute(pairs)


def test_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(420)] + [(7, rng.randrange(600)) for _ in range(60)]
    assert sorted(map(tuple, connected_groups(links(spark, pairs)).collect())) == brute(pairs)


def test_hot_labels_take_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr("lectern.scale.HOT_ROWS", 1)
    pairs = STAR + CHAIN[:50]
    assert sorted(map(tuple, connected_groups(links(spark, pairs)).collect())) == brute(pairs)


def test_empty(spark):
    assert connected_groups(links(spark, [])).count() == 0


def test_question_groups(spark):
    matches = spark.createDataFrame([(1, 2, 0.7, 0), (2, 3, 0.69, 0), (4, 4, 0.9, 0), (3, 900, 0.8, 0), (5, 6, None, 0), (2, 1, 0.9, 0), (None, 1, 0.9, 0)], "left_id int, right_id int, score double, label int")
    questions = spark.createDataFrame([(2, 7), (8, 7), (9, 7), (10, 11), (12, None), (None, 7), (20, -3), (21, -3)], "id int, repeat_group_id int")
    got = sorted(map(tuple, question_groups(matches, questions).collect()))
    assert got == [(1, 1), (1, 2), (1, 8), (1, 9), (3, 3), (3, 900), (20, 20), (20, 21)]
    assert question_groups(matches.where("false"), questions.where("false")).count() == 0
