from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from lectern.llm import similar
from lectern.llm.similar import forest_recall, leaf_bits, least_agreeing, one_bits, screen_bits, shortened_prefix, signatures, similar_groups, similar_pairs, sketches, tree_paths


def words(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


def bare(text):
    return re.sub(r"[\W_]+", "", (text or "").lower())


def brute(rows, threshold):
    held = [(i, words(t), bare(t)) for i, t in rows if words(t)]
    out = set()
    for n, (i, a, x) in enumerate(held):
        for j, b, y in held[n + 1 :]:
            k = len(a & b)
            if x != y and k >= threshold * (len(a) + len(b) - k) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows, threshold=0.7, **how):
    df = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "text", "1 as h", "'x' as words")
    got = [tuple(r) for r in similar_pairs(df, threshold, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(n, seed, base=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    while len(rows) < n:
        own = [rng.choice(vocabulary) for _ in range(base)]
        for _ in range(rng.choice([1, 1, 2, 4])):
            new = list(own)
            for _ in range(rng.randrange(8)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append((i, rng.choice([" ", ", "]).join(new)))
            i += 1
    return rows


def test_recall_and_exactness(spark):
    rows = texts(600, 1)
    want, got = brute(rows, 0.7), found(spark, rows)
    assert got <= want and len(got) >= 0.9 * len(want) > 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_recall_on_questions(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/questions.parquet").select("id", "text").collect()]
    want, got = brute(rows, 0.7), found(spark, rows)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_nulls_empty_long_and_copies(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "!!!"), (4, long), (5, long + " end"), (6, "a b c d"), (7, "A B, C d"), (8, "d c b a"), (9, "a bc d"), (None, "a b c d"), (10, "one"), (11, "One!")]
    assert found(spark, rows) == {(4, 5), (6, 8), (7, 8)}
    assert found(spark, []) == set()


def test_hot_groups_of_copies_meet_only_other_texts(spark):
    rng = random.Random(3)
    hot = " ".join(f"h{i}" for i in range(30))
    rows = [(i, hot if i % 3 else hot.upper()) for i in range(400)] + [(1000, hot.replace("h7 ", "x ")), (1001, " ".join(rng.sample(hot.split(), 30)))]
    got = found(spark, rows)
    assert got == {(i, 1000) for i in range(400)} | {(i, 1001) for i in range(400)} | {(1000, 1001)}


def test_crowded_nodes_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "NODE_TEXTS", 2)
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"z{rng.randrange(9)}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(40)) for i in range(40))]
    want, got = brute(rows, 0.7), found(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want) > 400


def test_nodes_large_in_one_block_are_spread(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT_TEXTS", 3)
    rng = random.Random(10)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"z{rng.randrange(9)}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(40)) for i in range(60))]
    want, got = brute(rows, 0.7), found(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want) > 900


def test_model_of_recall():
    recall = forest_recall(0.7, 0.7)
    assert (np.diff(recall) <= 0).all() and recall[6] > 0.92 > recall[7]
    assert shortened_prefix(0.7, 0.92) == 7 and shortened_prefix(0.9, 0.92) == 8 and shortened_prefix(0.7, 0.999) < 7
    assert 20 < screen_bits(0.7) < 64 and least_agreeing(64, 0.7, 0.0) == 0 < least_agreeing(64, 0.7, 0.04) < least_agreeing(64, 0.9, 0.04)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
    m = signatures(np.concatenate([a, b]).astype(np.uint32), np.array([0, 100, 200]))
    assert abs((m[:, 0] == m[:, 1]).mean() - 80 / 120) < 0.13
    assert sketches(one_bits(m)).shape == (2, similar.SKETCH_BITS // 8)


@pytest.mark.parametrize("shared, size", [(42, 51), (32, 38), (33, 39)])  # 0.70, 0.73, 0.73
def test_recall_right_at_the_threshold(shared, size):
    rng, n = np.random.default_rng(5), 1500
    sets = []
    for _ in range(n):
        w = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
        sets += [w[:size], np.concatenate([w[:shared], w[size:]])]
    m = signatures(np.concatenate(sets).astype(np.uint32), np.arange(2 * n + 1) * size)
    paths = tree_paths(m) >> np.uint64(8 * (similar.DEPTH - shortened_prefix(0.7, 0.92)))
    bits, least = one_bits(m), least_agreeing(8 * similar.LEAF_TREES, 0.7, similar.LEAF_LOSS)
    found_in = np.array([(paths[t, ::2] == paths[t, 1::2]) & (8 * similar.LEAF_TREES - np.bitwise_count(leaf_bits(bits, t)[::2] ^ leaf_bits(bits, t)[1::2]) >= least) for t in range(similar.TREES)])
    sketch = sketches(bits).view(np.uint64)
    close = np.bitwise_count(sketch[::2] ^ sketch[1::2]).sum(axis=1) <= screen_bits(0.7)
    assert (found_in.any(axis=0) & close).mean() > 0.9


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 1 << 31, 50), rng.integers(-5, 1 << 62, 50)):
        pieces = [(t, np.sort(rng.integers(0, 1 << 63, 25).astype(np.uint64)), ids[k : k + 25], rng.integers(0, 1 << 63, 25).astype(np.uint64)) for t, k in ((0, 0), (similar.TREES - 1, 25))]
        for level in (1, 7, 8):
            cut, kept = np.uint64(8 * (8 - level)), np.uint64((1 << 8 * similar.LEAF_TREES) - 1)
            for (t, path, doc, leaf), want in zip(similar._unpack(similar._pack(pieces, level), level), pieces):
                assert t == want[0] and (path >> cut == want[1] >> cut).all() and (doc == want[2]).all() and (leaf == want[3] & kept).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_by_band_of_similarity(spark):
    """Against an exact join over rare words, per 0.02 of similarity."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/questions.parquet").select("id", "text").collect()]
    held = {i: (words(t), bare(t)) for i, t in rows if words(t)}
    seen = {}
    for w, _ in held.values():
        for x in w:
            seen[x] = seen.get(x, 0) + 1
    index, want = {}, {}
    for i, (w, b) in held.items():
        prefix = sorted(w, key=lambda x: (seen[x], x))[: len(w) - -(-7 * len(w) // 10) + 1]
        for j in {j for x in prefix for j in index.get(x, ())}:
            v, c = held[j]
            k = len(w & v)
            if b != c and k >= 0.7 * (len(w) + len(v) - k) - 1e-9:
                want[(min(i, j), max(i, j))] = k / (len(w) + len(v) - k)
        for x in prefix:
            index.setdefault(x, []).append(i)
    got = found(spark, rows)
    assert got <= set(want) and len(got) >= 0.98 * len(want) > 300
    for low in np.arange(0.7, 1, 0.02):
        band = [p for p, s in want.items() if low <= s + 1e-12 < low + 0.02]
        assert sum(p in got for p in band) >= 0.9 * len(band) - 1, low


def test_groups_of_near_duplicates(spark):
    base = [f"b{i}" for i in range(30)]
    rows = [(k, " ".join(base[k:] + [f"n{x}" for x in range(k)])) for k in range(0, 12, 2)] + [(50, "alone in the world"), (51, "Alone, in the world!"), (52, None), (53, "")]
    df = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "text", "'x' as rep")
    got = {r["doc"]: (r["rep"], r["group_id"]) for r in similar_groups(df, 0.7).collect()}
    assert got == {**{k: (k, 0) for k in range(0, 12, 2)}, 50: (50, 50), 51: (50, 50)}
    assert similar_groups(df.where("false"), 0.7).count() == 0
