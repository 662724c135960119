"""Mixing sources to target weights by fixed-length token blocks.

The token stream of each source is cut into blocks of a fixed length. Each output shard draws how many of its slots
each source fills from a multinomial, conditioned on the totals that the target shares need (that is a multivariate
hypergeometric draw), so that the shares of the whole are exact to a block. Draws halve the range of shards again and
again, each with a generator of its own, so that every task finds the counts of its shards without those before. Slot k of
a source maps through a pseudorandom permutation of its block indices, a new one for each repeat, and blocks are joined
by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import with_tokens
from lectern.scale import cut, parts_for

#: Tokens of a block, slots of an output shard, documents of a numbering bucket, and the most sources.
BLOCK_TOKENS, SHARD_SLOTS, BUCKET_DOCUMENTS, MOST_SOURCES = 1024, 4096, 20_000, 1_000
#: Output shards whose slots a task fills.
TASK_SHARDS = 64


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel network, walked until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right, h, m, k = out[todo] >> half[todo], out[todo] & mask[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        for r in range(4):
            mixed = (right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed = mixed * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(24)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def block_budget(blocks: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> dict[str, int]:
    """Slots per source of the largest mixture with the target shares in which no source exceeds its repeats.

    Sources without blocks can't take part; the shares of the rest are scaled to one.
    """
    live = {s: w for s, w in shares.items() if blocks.get(s) and w > 0 and repeats[s] > 0}
    if not live:
        return {}
    whole = sum(live.values())
    total = min(blocks[s] * repeats[s] / (w / whole) for s, w in live.items())
    exact = {s: total * w / whole for s, w in live.items()}
    slots = {s: min(int(x + 1e-9), blocks[s] * repeats[s]) for s, x in exact.items()}
    return slots


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. Beyond the library's range by inversion of the distribution
    within 12 deviations of its mean."""
    whole = good + bad
    if whole < 10**9 or not good or not bad or not n:
        return int(rng.hypergeometric(good, bad, n)) if whole < 10**9 else n if not bad else 0
    mean = n * (good / whole)
    wide = 12 * (mean * (bad / whole) * ((whole - n) / whole)) ** 0.5 + 12
    low, high = max(0, n - bad, int(mean - wide)), min(n, good, int(mean + wide) + 1)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(np.searchsorted(below, rng.random() * below[-1]))


def shard_counts(slots: dict[str, int], shard_slots: int, seed: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """(shard, [(source, first slot of the source, slots), ...]) for the shards from ``begin`` to ``end``, or all.

    A range of shards splits its slots between its halves by a multivariate hypergeometric draw seeded by the range, so
    the counts of a shard are the same whoever draws them. Every shard but the last has ``shard_slots`` slots.
    """
    names, total = sorted(slots), sum(slots.values())
    shards = -(-total // shard_slots)
    end = shards if end is None else min(end, shards)

    def walk(low: int, high: int, held: list[int], done: list[int]) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
        if high <= begin or low >= end:
            return
        if high - low == 1:
            yield low, [(s, f, n) for s, f, n in zip(names, done, held) if n]
            return
        middle = (low + high) // 2
        rng, want, rest, first = np.random.default_rng([seed, low, high]), (middle - low) * shard_slots, sum(held), []
        for n in held:
            rest -= n
            first.append(hypergeometric(rng, n, rest, want))
            want -= first[-1]
        yield from walk(low, middle, first, done)
        yield from walk(middle, high, [n - x for n, x in zip(held, first)], [d + x for d, x in zip(done, first)])

    if shards:
        yield from walk(0, shards, [slots[s] for s in names], [0] * len(names))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """(shard, slot, source, repeat_no, block_no, doc_id, first_token, n_tokens): the pieces of documents in each slot.

    Documents whose source is null or no target take no part, nor do texts without tokens. Of targets named twice the
    first by share counts; null or non-positive shares and repeats drop a target. A source missing from documents is
    left out and the other shares are scaled. Each block is used at most max_repeats times, once a repeat. The last
    block of a source may be shorter. No documents or no targets give no rows.
    """
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = documents.sparkSession
    schema = "shard int, slot int, source string, repeat_no int, block_no long, doc_id long, first_token int, n_tokens int"
    names = sorted(r["source"] for r in rows)
    number = {s: i for i, s in enumerate(names)}
    shares, repeats = {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}
    if not rows:
        return spark.createDataFrame([], schema)
    buckets = parts_for(documents.count(), BUCKET_DOCUMENTS)
    source_no = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for s, i in number.items()), F.lit(None).cast("int"))
    counted = cut(
        with_tokens(documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_no.alias("s"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), "text").where("s is not null and doc_id is not null"), vocabulary=vocabulary).where("n_tokens > 0")
    )
    sums = counted.groupBy("s", "bucket").agg(F.sum("n_tokens").alias("n"))
    sizes = dict.fromkeys(number.values(), 0) | {r["s"]: r["n"] for r in sums.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    blocks = {s: -(-sizes[i] // block_tokens) for s, i in number.items()}
    slots = block_budget(blocks, shares, repeats)
    if not slots:
        return spark.createDataFrame([], schema)

    # the blocks that each document's tokens lie in
    w = Window.partitionBy("s", "bucket").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one narrow row a bucket
    at = counted.join(sums.select("s", "bucket", base.alias("base")), ["s", "bucket"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    end = F.col("begin") + F.col("n_tokens")
    touched = at.select("s", "doc_id", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block_tokens), F.floor((end - 1) / block_tokens))).alias("block_no"))
    low, high = F.greatest(F.col("begin"), F.col("block_no") * block_tokens), F.least(F.col("end"), (F.col("block_no") + 1) * block_tokens)
    pieces = touched.select("s", "block_no", "doc_id", (low - F.col("begin")).cast("int").alias("first_token"), (high - low).cast("int").alias("n_tokens"))

    shards = -(-sum(slots.values()) // shard_slots)
    n_blocks = {number[s]: n for s, n in blocks.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["id"].to_numpy()
            if not len(own):
                continue
            for shard, counts in shard_counts(slots, shard_slots, seed, int(own.min()), int(own.max()) + 1):
                filled = 0
                for source, first, n in counts:
                    s, k = number[source], np.arange(first, first + n)
                    size = n_blocks[s]
                    repeat = k // size
                    key = (np.uint64(seed) << np.uint64(40)) + (np.uint64(s) << np.uint64(20)) + repeat.astype(np.uint64)
                    block = permuted(k % size, np.full(n, size, dtype=np.int64), key)
                    slot = np.arange(filled, filled + n, dtype=np.int32)
                    filled += n
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, dtype=np.int32)), pa.array(slot), pa.array(np.full(n, s, dtype=np.int32)), pa.array(repeat.astype(np.int32)), pa.array(block)], names=["shard", "slot", "s", "repeat_no", "block_no"])

    placed = spark.range(0, shards, 1, parts_for(shards, TASK_SHARDS)).mapInArrow(place, "shard int, slot int, s int, repeat_no int, block_no long")
    name = F.element_at(F.array(*(F.lit(s) for s in names)), F.col("s") + 1)
    return placed.join(pieces, ["s", "block_no"]).select("shard", "slot", name.alias("source"), "repeat_no", "block_no", "doc_id", "first_token", "n_tokens")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its share wanted and reached, tokens, and the times its most used block is used."""
    own = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("repeat_no") + 1).alias("repeats"))
    total = own.agg(F.sum("n_tokens").alias("total"))
    return (
        targets.select("source", "target_share", "max_repeats").join(own, "source", "left").crossJoin(F.broadcast(total))
        .select("source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats")
    )


def documents_chosen(mixed: DataFrame) -> DataFrame:
    """Per chosen document: the tokens taken from it in all, and in how many repeats of its source it occurs."""
    return mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("repeat_no").alias("repeats"))
