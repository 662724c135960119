"""Filling fixed-capacity containers: best-two-fit over token counts.

Documents are spread over packing groups by a hash of their id, so that a group has a bounded number of items whatever
the corpus. Within a group containers are filled greedily with the largest item that fits; then a container's smallest
document is replaced by the two unpacked documents that together fit the widened gap more tightly.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import with_tokens
from lectern.scale import parts_for

#: Documents in a packing group, and the most container sizes taken to the driver.
GROUP_DOCUMENTS, MOST_SPECS = 20_000, 1_000

PLACED = "spec_id int, container_id long, doc_id long, piece int, first_token int, n_tokens int, used_tokens int, fill double"


class Pool:
    """Unpacked items by size; answers which size, at most a given one, is the largest present."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.items: dict[int, list[int]] = {}
        for i in order[::-1]:
            self.items.setdefault(int(sizes[i]), []).append(int(i))
        self.sizes = sorted(self.items)

    def largest(self, most: int) -> int:
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        if not held:
            del self.items[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return item

    def put(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            insort(self.sizes, size)
        self.items[size].append(item)

    def best_pair(self, most: int, least: int) -> tuple[int, int]:
        """Two sizes whose sum is the largest in (least, most]; zeros where there is none. Two indices move inwards."""
        low, high, best = 0, bisect_right(self.sizes, most) - 1, (0, 0)
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if a + b > most or (low == high and len(self.items[a]) < 2):
                high -= 1
                continue
            if a + b > least:
                best, least = (a, b), a + b
                if a + b == most:
                    break
            low += 1
        return best


def best_two_fit(sizes: np.ndarray, capacity: int, separator: int) -> list[list[int]]:
    """Containers as lists of item indices; every size is from 1 to ``capacity``."""
    pool, out = Pool(sizes), []
    while pool.sizes:
        size = pool.sizes[-1]
        held = [(size, pool.take(size))]
        gap = capacity - size
        while (size := pool.largest(gap - separator)) > 0:
            held.append((size, pool.take(size)))
            gap -= size + separator
        if gap > 0 and len(held) > 1:
            small, item = held[-1]  # taken last, hence the smallest
            # two items instead of one cost one separator more
            a, b = pool.best_pair(gap + small - separator, small)
            if a:
                first, second = pool.take(b), pool.take(a)
                pool.put(small, item)
                held[-1:] = [(b, first), (a, second)]
        out.append([i for _, i in held])
    return out


def packed(documents: DataFrame, specs: DataFrame, vocabulary: str | None = None, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """A row for each document piece: container, first token and number of tokens in its document, and the tokens the
    container uses (separators included) with its fill.

    Documents longer than the capacity, and only those, are split: into full containers and a rest that is packed as
    an item. Null and empty texts have no tokens and are in no container. Specs with a capacity below one token or a
    null are left out, a null separator is none. A repeated doc_id packs each of its rows. No documents or specs give
    no rows.
    """
    wanted = specs.where("capacity_tokens > 0 and spec_id is not null").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens")).distinct().limit(MOST_SPECS + 1).collect()
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    groups = parts_for(documents.count(), group_documents)
    counted = with_tokens(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary=vocabulary).where("n_tokens > 0 and doc_id is not null")
    sizes = F.array(*(F.struct(F.lit(r[0]).alias("spec_id"), F.lit(r[1]).alias("capacity"), F.lit(r[2]).alias("separator")) for r in wanted))
    if not wanted:
        return documents.sparkSession.createDataFrame([], PLACED)
    items = counted.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), "doc_id", "n_tokens", F.explode(sizes).alias("s")).select("g", "doc_id", "n_tokens", "s.*")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        spec, capacity, separator = (table[c][0].as_py() for c in ("spec_id", "capacity", "separator"))
        group, docs, tokens = table["g"][0].as_py(), table["doc_id"].to_numpy(), table["n_tokens"].to_numpy().astype(np.int64)
        full, rest = tokens // capacity, tokens % capacity
        n_full = int(full.sum())
        cut_docs = np.repeat(np.arange(len(docs)), full)
        piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        open_items = np.flatnonzero(rest)
        bins = best_two_fit(rest[open_items], capacity, separator)
        place = np.array([i for b in bins for i in b], dtype=np.int64)
        count = np.array([len(b) for b in bins], dtype=np.int64)
        at = open_items[place] if len(place) else np.array([], dtype=np.int64)
        which = np.repeat(np.arange(len(bins)), count)
        used = np.bincount(which, weights=rest[at], minlength=len(bins)).astype(np.int64) + (count - 1) * separator
        used_all = np.concatenate([np.full(n_full, capacity, dtype=np.int64), used[which]])
        return pa.table({
            "spec_id": pa.array(np.full(n_full + len(at), spec, dtype=np.int32)),
            "container_id": (group << 32) + np.concatenate([np.arange(n_full), n_full + which]),
            "doc_id": docs[np.concatenate([cut_docs, at])],
            "piece": np.concatenate([piece, full[at]]).astype(np.int32),
            "first_token": np.concatenate([piece * capacity, full[at] * capacity]).astype(np.int32),
            "n_tokens": np.concatenate([np.full(n_full, capacity), rest[at]]).astype(np.int32),
            "used_tokens": used_all.astype(np.int32),
            "fill": used_all / capacity,
        })

    return items.groupBy("spec_id", "g").applyInArrow(pack, PLACED)


def container_summary(placed: DataFrame) -> DataFrame:
    """Per container size: containers, document pieces, tokens, and mean fill."""
    bins = placed.groupBy("spec_id", "container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.first("fill").alias("fill"))
    return bins.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.round(F.avg("fill"), 6).alias("mean_fill"))
