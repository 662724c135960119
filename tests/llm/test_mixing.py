from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from lectern.llm.mixing import block_budget, documents_chosen, hypergeometric, mixture, permuted, shard_counts, shares_reached
from lectern.llm.tokens import with_tokens


def test_permutations():
    for n in (1, 2, 3, 10, 257, 5000):
        index = np.arange(n)
        one = permuted(index, np.full(n, n), np.full(n, 7))
        assert sorted(one.tolist()) == list(range(n))
        if n > 100:
            assert (one != index).mean() > 0.9 and (one != permuted(index, np.full(n, n), np.full(n, 8))).mean() > 0.9


def test_budget_is_the_largest_within_repeats():
    slots = block_budget({"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 9})
    assert slots == {"a": 37, "b": 30}
    assert block_budget({}, {"a": 1.0}, {"a": 1}) == {}


def test_shards_add_up():
    slots = {"a": 1000, "b": 37, "c": 1}
    rows = list(shard_counts(slots, 64, 3))
    total = Counter()
    for shard, counts in rows:
        for s, begin, n in counts:
            assert begin == total[s]
            total[s] += n
    assert dict(total) == slots and [shard for shard, _ in rows] == list(range(17))
    assert {sum(n for _, _, n in c) for _, c in rows[:-1]} == {64}
    for begin, end in ((0, 1), (3, 9), (16, 40)):
        assert list(shard_counts(slots, 64, 3, begin, end)) == [r for r in rows if begin <= r[0] < end]


def test_draws_of_any_size():
    rng = np.random.default_rng(1)
    for good, bad, n in ((600, 400, 100), (3 * 10**10, 7 * 10**10, 5 * 10**10)):
        mean, sd = n * good / (good + bad), (n * good / (good + bad) * bad / (good + bad) * (good + bad - n) / (good + bad)) ** 0.5
        drawn = np.array([hypergeometric(rng, good, bad, n) for _ in range(60)])
        assert abs(drawn.mean() - mean) < 5 * sd / 60**0.5 and 0.6 * sd < drawn.std() < 1.5 * sd
    assert hypergeometric(rng, 10**10, 0, 5) == 5 and hypergeometric(rng, 0, 10**10, 5) == 0
    big = {"a": 4 * 10**9, "b": 10**9}
    counts = [c for _, c in shard_counts(big, 4096, 3, 700_000, 700_003)]
    assert all(sum(n for _, _, n in c) == 4096 and abs(c[0][2] - 3277) < 200 for c in counts)


def tables(spark):
    docs = [(i, f"word{i % 7} " * (20 + i % 50), "big" if i % 4 else "small", 3) for i in range(200)] + [(500, None, "big", 3), (501, "", "big", 3), (502, "x y", None, 3), (503, "x y", "other", 3)]
    targets = [("big", 0.5, 1), ("small", 0.5, 2), ("gone", 0.2, 3), (None, 0.1, 1), ("zero", 0.0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, s int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixture(spark):
    docs, targets = tables(spark)
    mixed = mixture(docs, targets, block_tokens=64, shard_slots=16).cache()
    rows = mixed.collect()
    assert {r["source"] for r in rows} == {"big", "small"} and max(r["repeat_no"] for r in rows if r["source"] == "big") == 0
    own = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert all(own[r["doc_id"]] == r["source"] for r in rows)
    tokens = {r["doc_id"]: r["n_tokens"] for r in with_tokens(docs.select("doc_id", "text").where("doc_id is not null")).collect()}
    used, slots, blocks = defaultdict(set), defaultdict(int), defaultdict(set)
    for r in rows:
        span = range(r["first_token"], r["first_token"] + r["n_tokens"])
        assert span.stop <= tokens[r["doc_id"]]
        for t in span:
            assert (r["repeat_no"], t) not in used[r["doc_id"]]
            used[r["doc_id"]].add((r["repeat_no"], t))
        slots[r["shard"], r["slot"]] += r["n_tokens"]
        blocks[r["shard"], r["slot"]].add((r["source"], r["repeat_no"], r["block_no"]))
    assert all(len(b) == 1 for b in blocks.values()) and max(slots.values()) == 64
    shares = {r["source"]: r for r in shares_reached(mixed, targets.where("source is not null")).collect()}
    assert abs(shares["big"]["actual_share"] - 0.5) < 0.02 and shares["gone"]["actual_share"] == 0 and shares["small"]["repeats"] <= 2
    assert documents_chosen(mixed).count() == len({r["doc_id"] for r in rows})
    again = mixture(docs, targets, block_tokens=64, shard_slots=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_empty(spark):
    docs, targets = tables(spark)
    assert mixture(docs.where("false"), targets).count() == 0 and mixture(docs, targets.where("false")).count() == 0
