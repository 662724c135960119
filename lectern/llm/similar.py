"""Near-duplicate texts: a MinHash LSH forest over the distinct words of each text, then exact verification.

A signature is TREES x DEPTH minima of hashed words. Each tree is a prefix trie over its own DEPTH minima, one byte a
level, kept as sorted keys: texts below one node share a prefix, and shortening every prefix by a level merges
neighbouring runs. Prefixes are shortened from DEPTH, level by level, until pairs right at the threshold are found with the
target recall, the screen of the leaves counted (``forest_recall``). No two trees share a minimum.

Behind its path a leaf holds one-bit minima from the trees that follow, so that texts below one node are screened where
they meet and only likely pairs leave the task. Entries travel as packed columns, one block a partition, not as rows.
Texts with equal word sets are one node: all but one are dropped within each packed block before the shuffle, and what
is left is mapped to one representative after it. Candidates of all trees are then verified on their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.grouping import connected_groups
from lectern.scale import all_cores, cut, parts_for, release, skew_safe_join

#: Trees, minima (levels) of each, and following trees whose bits stand in a leaf (8 bits each, 8 trees at most).
TREES, DEPTH, LEAF_TREES = 32, 8, 6
POOL = TREES * DEPTH
#: Share of pairs at the threshold that the screen of a leaf may drop; each tree draws other bits, so this isn't lost for good.
LEAF_LOSS = 0.04
#: Bits of the sketch that screens candidates once more, and how many standard deviations below its expectation a pair may lie.
SKETCH_BITS, SCREEN_SIGMA = 128, 4.0
#: Tree entries a partition aims at, and entries packed at a time.
PART_ENTRIES, FLUSH_ENTRIES = 3_000_000, 3_000_000
#: Texts below one node that meet within a task; larger nodes are joined block by block. Texts of one packed block from
#: which a node counts as large at once, so that no task gets all texts of a node that holds much of the table.
NODE_TEXTS, BLOCK_TEXTS, HOT_TEXTS = 2048, 512, 1024
#: Pairs of a partition held before repeated ones are dropped.
HELD_PAIRS = 2_000_000


def least_agreeing(bits: int, similarity: float, loss: float) -> int:
    """The most of ``bits`` one-bit minima that may be demanded to agree when ``loss`` of such pairs may fail."""
    p, below = (1 + similarity) / 2, 0.0
    for k in range(bits + 1):
        below += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if below > loss:
            return k
    return bits


def forest_recall(similarity: float, threshold: float, draws: int = 20_000) -> np.ndarray:
    """Recall of pairs of this similarity at each prefix length from 1 to DEPTH, for a forest screened at ``threshold``.

    Drawn, not computed: trees screen by minima of other trees, so they aren't independent.
    """
    rng = np.random.default_rng(7)
    agree = rng.random((draws, TREES, DEPTH), dtype=np.float32) < similarity
    bits = (agree | (rng.random((draws, TREES, DEPTH), dtype=np.float32) < 0.5)).sum(axis=2)
    least = least_agreeing(8 * LEAF_TREES, threshold, LEAF_LOSS)
    close = sum(np.roll(bits, -k, axis=1) for k in range(1, LEAF_TREES + 1)) >= least
    held = np.logical_and.accumulate(agree, axis=2)
    return np.array([float((held[:, :, d] & close).any(axis=1).mean()) for d in range(DEPTH)])


def shortened_prefix(threshold: float, target: float) -> int:
    """Levels left when prefixes are shortened from DEPTH until pairs right at the threshold reach the target recall."""
    recall, level = forest_recall(threshold, threshold), DEPTH
    while level > 1 and recall[level - 1] < target:
        level -= 1
    return level


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    xors = rng.integers(0, 1 << 32, POOL, dtype=np.uint64).astype(np.uint32)
    odds = (rng.integers(0, 1 << 32, POOL, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    return xors, odds


def signatures(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """POOL minima for each text of hashed words; starts has one more entry than texts, and no text is empty."""
    xors, odds = _constants()
    out = np.empty((POOL, len(starts) - 1), dtype=np.uint32)
    step = 1024
    for a in range(0, len(starts) - 1, step):
        b = min(a + step, len(starts) - 1)
        chunk = words[starts[a] : starts[b]]
        at = starts[a:b] - starts[a]
        mixed = np.empty_like(chunk)
        for k in range(POOL):
            np.bitwise_xor(chunk, xors[k], out=mixed)
            np.multiply(mixed, odds[k], out=mixed)
            out[k, a:b] = np.minimum.reduceat(mixed, at)
    return out


def tree_paths(minima: np.ndarray) -> np.ndarray:
    """(TREES, texts): the path of each text in each tree, DEPTH levels of a byte, the first level in front."""
    levels = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return np.ascontiguousarray(levels.reshape(TREES, DEPTH, -1).transpose(0, 2, 1)).view(">u8")[:, :, 0].astype(np.uint64)


def one_bits(minima: np.ndarray) -> np.ndarray:
    """(texts, TREES): a byte of DEPTH one-bit minima for each tree."""
    mixed = minima * np.uint32(0x85EBCA6B)
    return np.packbits(((mixed >> np.uint32(16)) & np.uint32(1)).astype(np.uint8), axis=0).T.copy()


def leaf_bits(bits: np.ndarray, tree: int) -> np.ndarray:
    """What the leaves of a tree hold for its screen: the bits of the LEAF_TREES trees that follow."""
    own = np.zeros((len(bits), 8), dtype=np.uint8)
    own[:, :LEAF_TREES] = bits[:, (tree + 1 + np.arange(LEAF_TREES)) % TREES]
    return own.view("<u8")[:, 0]


def sketches(bits: np.ndarray) -> np.ndarray:
    """SKETCH_BITS of the bits, one row a text."""
    return np.ascontiguousarray(bits[:, : SKETCH_BITS // 8])


def screen_bits(threshold: float) -> int:
    """Most differing sketch bits of a pair at the threshold, up to SCREEN_SIGMA deviations."""
    p = (1 - threshold) / 2
    return int(SKETCH_BITS * p + SCREEN_SIGMA * (SKETCH_BITS * p * (1 - p)) ** 0.5)


#: Distinct words of a text: maximal runs of letters or digits, lower-cased.
WORDS = r"filter(array_distinct(split(lower(text), '[^\\p{L}\\p{N}]+')), w -> w <> '')"
BARE = r"regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '')"

NODES = "kind int, a long, b long, h long, bare long, s0 long, s1 long"


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch["words"]
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), starts - starts[0]


def word_sets(texts: DataFrame) -> DataFrame:
    """(doc, words, bare): hashed distinct words and hashed bare text of (doc, text); texts without a word are left out."""
    words = all_cores(texts.where(F.col("text").isNotNull() & F.col("doc").isNotNull()).select("doc", "text")).select(F.col("doc").cast("long").alias("doc"), F.expr(WORDS).alias("w"), F.expr(f"xxhash64({BARE})").alias("bare"))
    return words.where(F.size("w") > 0).select("doc", F.expr("transform(w, x -> xxhash64(x))").alias("words"), "bare")


def set_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word set, whatever the order of its words."""
    mixed = (words ^ (words >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts[:-1])


#: Kinds of packed blocks: tree entries, what is known of each text, members of large nodes, names of large nodes.
ENTRIES, KNOWN, MEMBERS, LARGE = range(4)


def node_names(tree: int, prefix: np.ndarray) -> np.ndarray:
    """A 64-bit name of each node, given as a tree and its prefix."""
    h = (prefix ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _tree_blocks(sets: DataFrame, level: int, parts: int) -> DataFrame:
    """(part, kind, data): packed blocks for each part of the forest. A node of ``level`` levels has one part."""
    cut_at = np.uint64(8 * (DEPTH - level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            words, starts = _words(b)
            doc, h = b["doc"].to_numpy(), set_hashes(words, starts)
            minima = signatures(words.astype(np.uint32), starts)
            held.append((doc, h, b["bare"].to_numpy(), one_bits(minima), tree_paths(minima)))
            n += len(doc)
            if n * TREES >= FLUSH_ENTRIES:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        doc, h, bare, bits = (np.concatenate([x[i] for x in held]) for i in range(4))
        paths = np.concatenate([x[4] for x in held], axis=1)
        order = np.lexsort((doc, h))
        one = np.sort(order[np.concatenate([[True], h[order][1:] != h[order][:-1]])])  # the first text of each set here
        out: list[tuple[int, int, bytes]] = []
        pieces: list[list[tuple]] = [[] for _ in range(parts)]
        for tree in range(TREES):
            path, own, leaf = paths[tree, one], doc[one], leaf_bits(bits[one], tree)
            names = node_names(tree, path >> cut_at)
            part = (names % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((path, part))
            path, own, leaf, names, part = path[order], own[order], leaf[order], names[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            size = np.diff(np.append(first, len(names)))
            if size.max() > HOT_TEXTS:
                large = np.repeat(size > HOT_TEXTS, size)
                for f, m in zip(first[size > HOT_TEXTS], size[size > HOT_TEXTS]):
                    name = names[f].astype(np.int64)
                    out.append((int(part[f]), LARGE, name.tobytes()))
                    spread = (own[f : f + m].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
                    out += [(int(p), MEMBERS, np.stack([np.full(int((spread == p).sum()), name), own[f : f + m][spread == p]]).tobytes()) for p in np.unique(spread)]
                path, own, leaf, part = path[~large], own[~large], leaf[~large], part[~large]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                if cuts[p] < cuts[p + 1]:
                    at = slice(cuts[p], cuts[p + 1])
                    pieces[p].append((tree, path[at], own[at], leaf[at]))
        out += [(p, ENTRIES, _pack(x, level)) for p, x in enumerate(pieces) if x]
        known = np.concatenate([doc, h.view(np.int64), bare, sketches(bits).view("<i8")[:, 0], sketches(bits).view("<i8")[:, 1]]).astype("<i8").tobytes()
        out.append((int(h[0] % np.uint64(parts)), KNOWN, known))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["part", "kind", "data"])

    return sets.mapInArrow(run, "part int, kind int, data binary")


def _pack(pieces: list[tuple], level: int) -> bytes:
    """Tree entries, their paths shortened to ``level``, byte column by byte column, so that sorted paths and the high bytes
    of ids compress."""
    docs = np.concatenate([x[2] for x in pieces])
    wide = 8 if docs.min() < 0 or docs.max() >= 1 << 32 else 4
    counts = np.zeros(TREES, dtype="<u4")
    for x in pieces:
        counts[x[0]] = len(x[1])
    by_column = lambda a, width, kept: np.ascontiguousarray(a.view(np.uint8).reshape(len(a), width)[:, :kept].T).tobytes()
    coded = by_column(np.concatenate([x[1] for x in pieces]).astype(">u8"), 8, level) + by_column(docs.astype("<u4" if wide == 4 else "<i8"), wide, wide)
    leaves = np.concatenate([x[3] for x in pieces]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LEAF_TREES].tobytes()  # as good as random
    squeezed = pa.Codec("zstd", 1).compress(coded, asbytes=True)
    return bytes([wide]) + counts.tobytes() + len(squeezed).to_bytes(4, "little") + squeezed + leaves


def _unpack(block: bytes, level: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tree, paths, ids, leaf bits) of each tree in a packed block."""
    wide, counts = block[0], np.frombuffer(block, "<u4", TREES, 1).astype(np.int64)
    at, n = 1 + 4 * TREES, int(counts.sum())
    size = int.from_bytes(block[at : at + 4], "little")
    coded = np.frombuffer(pa.decompress(block[at + 4 : at + 4 + size], decompressed_size=(level + wide) * n, codec="zstd", asbytes=True), np.uint8)
    held = np.zeros((n, 8), dtype=np.uint8)
    held[:, :level] = coded[: level * n].reshape(level, n).T
    paths = held.view(">u8")[:, 0].astype(np.uint64)
    docs = np.ascontiguousarray(coded[level * n :].reshape(wide, n).T).view("<u4" if wide == 4 else "<i8")[:, 0].astype(np.int64)
    leaf = np.zeros((n, 8), dtype=np.uint8)
    leaf[:, :LEAF_TREES] = np.frombuffer(block, np.uint8, LEAF_TREES * n, at + 4 + size).reshape(n, LEAF_TREES)
    ends = np.cumsum(counts)
    return [(t, paths[e - c : e], docs[e - c : e], leaf.view("<u8")[e - c : e, 0]) for t, (c, e) in enumerate(zip(counts, ends)) if c]


def unique_pairs(pairs: list[np.ndarray]) -> np.ndarray:
    """The pairs of several arrays, smaller id first, each once."""
    out = np.concatenate([np.empty((0, 2), dtype=np.int64), *pairs])
    out.sort(axis=1)
    out = out[np.lexsort((out[:, 1], out[:, 0]))]
    return out[np.concatenate([[True], (out[1:] != out[:-1]).any(axis=1)])] if len(out) else out


def pairs_in_runs(docs: np.ndarray, leaf: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Pairs within each run whose leaf bits differ in at most ``most`` places. Runs of one size are taken together."""
    out = []
    for n in np.unique(size[size > 1]):
        i, j = np.triu_indices(n, 1)
        starts, step = first[size == n], max(1, HELD_PAIRS // len(i))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None]
            close = np.bitwise_count(leaf[at + i] ^ leaf[at + j]) <= most
            row, pair = np.nonzero(close)
            out.append(np.stack([docs[starts[k + row] + i[pair]], docs[starts[k + row] + j[pair]]], axis=1))
    return out


def _nodes(blocks: DataFrame, level: int, parts: int, threshold: float) -> DataFrame:
    """Rows of three kinds: 0 a candidate pair (a, b); 1 a member a of the large node h; 2 a text a with its set hash,
    bare-text hash and sketch."""
    cut_at = np.uint64(8 * (DEPTH - level))
    most = 8 * LEAF_TREES - least_agreeing(8 * LEAF_TREES, threshold, LEAF_LOSS)

    def rows(kind: int, n: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "h", "bare", "s0", "s1"]
        for at in range(0, n, 50_000):
            size = min(50_000, n - at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, dtype=np.int32)), *(pa.array(columns[c][at : at + size]) if c in columns else pa.nulls(size, pa.int64()) for c in names)], names=["kind", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        large: list[np.ndarray] = []
        for batch in batches:
            for kind, block in zip(batch["kind"].to_pylist(), batch["data"]):
                data = block.as_py()
                if kind == ENTRIES:
                    for tree, *columns in _unpack(data, level):
                        found.setdefault(tree, []).append(columns)
                elif kind == LARGE:
                    large.append(np.frombuffer(data, "<i8").view(np.uint64))
                elif kind == MEMBERS:
                    name, member = np.frombuffer(data, "<i8").reshape(2, -1)
                    yield from rows(1, len(name), a=member, h=name)
                else:
                    known = np.frombuffer(data, "<i8").reshape(5, -1)
                    yield from rows(2, known.shape[1], a=known[0], h=known[1], bare=known[2], s0=known[3], s1=known[4])
        known_large = np.unique(np.concatenate(large)) if large else np.empty(0, dtype=np.uint64)
        pairs: list[np.ndarray] = []
        for tree in sorted(found):
            path, docs, leaf = (np.concatenate([x[k] for x in found[tree]]) for k in range(3))
            del found[tree]
            order = np.lexsort((docs, path))
            path, docs, leaf = path[order] >> cut_at, docs[order], leaf[order]
            first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            size = np.diff(np.append(first, len(path)))
            crowded = size > NODE_TEXTS
            if len(known_large):
                crowded |= np.isin(node_names(tree, path[first]), known_large)
            pairs += pairs_in_runs(docs, leaf, first[~crowded], size[~crowded], most)
            if sum(map(len, pairs)) > HELD_PAIRS:
                pairs = [unique_pairs(pairs)]
                if len(pairs[0]) > HELD_PAIRS:
                    yield from rows(0, len(pairs[0]), a=pairs[0][:, 0], b=pairs[0][:, 1])
                    pairs = []
            for f, n in zip(first[crowded], size[crowded]):
                name = node_names(tree, path[f : f + 1]).view(np.int64)[0]
                yield from rows(1, int(n), a=docs[f : f + n], h=np.full(n, name))
        left = unique_pairs(pairs)
        yield from rows(0, len(left), a=left[:, 0], b=left[:, 1])

    return blocks.repartitionById(parts, "part").mapInArrow(run, NODES)


def _crowded_pairs(members: DataFrame, sketch: DataFrame, most: int) -> DataFrame:
    """Screened pairs within large nodes, block against block: no task holds more than two blocks of texts.

    A node's texts are spread over blocks by a hash; each pair of blocks is one group, and only pairs whose sketches
    are close enough leave it.
    """
    sizes = members.groupBy("node").agg(F.count("*").alias("n")).select("node", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int").alias("blocks"))
    rows = members.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).join(sketch, "a")
    ways = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    spread = rows.select("node", "a", "s0", "s1", "block", F.explode(ways).alias("w")).select("node", "a", "s0", "s1", "block", "w.i", "w.j")

    def meet(table: pa.Table) -> pa.Table:
        ids, block = table["a"].to_numpy(), table["block"].to_numpy()
        s = np.stack([table["s0"].to_numpy(), table["s1"].to_numpy()], axis=1).astype(np.int64).view(np.uint64)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = [np.empty((0, 2), dtype=np.int64)]
        for x in left:
            y = right[ids[right] > ids[x]] if i == j else right
            y = y[np.bitwise_count(s[y] ^ s[x]).sum(axis=1) <= most]
            out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return spread.groupBy("node", "i", "j").applyInArrow(meet, "a long, b long")


def similar_sets(texts: DataFrame, threshold: float, target_recall: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of representatives whose word sets share at least ``threshold`` of their union, and the
    membership (doc, rep, bare) of every text with a word; its representative is the smallest id with its word set.

    Input (doc, text), doc unique; other columns are ignored. Null texts, null ids and texts without words take no part.
    ``target_recall`` holds for pairs right at the threshold; more similar ones are found more surely.
    """
    level, most = shortened_prefix(threshold, target_recall), screen_bits(threshold)
    total = texts.count()
    parts = parts_for(total * TREES, PART_ENTRIES, 12)
    nodes = cut(_nodes(_tree_blocks(word_sets(texts), level, parts), level, parts, threshold))
    known = nodes.where("kind = 2").select("a", "h", "bare", "s0", "s1")
    reps = known.groupBy("h").agg(F.min("a").alias("rep"), F.count("*").alias("m"))
    several = reps.where("m > 1").select("h", "rep")
    copies = cut(skew_safe_join(known.select("h", F.col("a").alias("doc"), "bare"), "h", several, total).select("doc", "rep", "bare"))
    moved = copies.where("doc <> rep").select("doc", "rep")
    members = known.select(F.col("a").alias("doc"), "bare").join(copies.select("doc"), "doc", "left_anti").select("doc", F.col("doc").alias("rep"), "bare").unionByName(copies)

    def on_reps(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(moved.toDF(column, "to"), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

    sketch = known.select("a", "s0", "s1")
    candidates = on_reps(on_reps(nodes.where("kind = 0").select("a", "b"), "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = F.expr("bit_count(a0 ^ b0) + bit_count(a1 ^ b1)")
    close = candidates.join(sketch.toDF("a", "a0", "a1"), "a").join(sketch.toDF("b", "b0", "b1"), "b").where(apart <= most).select("a", "b")
    crowded = nodes.where("kind = 1").select("a", F.col("h").alias("node"))
    if not crowded.isEmpty():
        close = close.unionByName(_crowded_pairs(on_reps(crowded, "a").distinct(), sketch, most)).distinct()
    kept = cut(close)
    pairs = cut(_verified(kept, texts, threshold))
    release(kept)
    return pairs, members


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose distinct words really share ``threshold`` of their union. Each text is shuffled once."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), "a", "b"), F.struct(F.col("b").alias("doc"), "a", "b"))).alias("s")).select("s.*")
    held = sides.join(texts.select(F.col("doc").cast("long").alias("doc"), "text"), "doc")
    both = held.groupBy("a", "b").agg(F.max_by("text", "doc").alias("x"), F.min_by("text", "doc").alias("y"))
    words = both.select("a", "b", F.expr(WORDS.replace("text", "x")).alias("x"), F.expr(WORDS.replace("text", "y")).alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    counted = words.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("both"))
    return counted.where(F.col("shared") >= F.lit(threshold) * (F.col("both") - F.col("shared")) - 1e-9).select("a", "b")


def similar_pairs(texts: DataFrame, threshold: float, target_recall: float = 0.92) -> DataFrame:
    """(id_a, id_b), id_a < id_b: texts of different bare form whose word sets are alike beyond the threshold.

    Texts of one word set count as alike when their bare forms differ. Copies of one bare form never meet each other:
    sets are expanded by their bare forms, so that a hot set of plain copies costs nothing.
    """
    pairs, members = similar_sets(texts, threshold, target_recall)
    x, y = members.toDF("x", "a", "bx"), members.toDF("y", "b", "by")
    across = pairs.join(x, "a").join(y, "b").where("bx <> by").select("x", "y")
    forms = members.groupBy("rep", "bare").agg(F.lit(1).alias("one"))
    mixed = cut(forms.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep"))
    several = forms.join(mixed, "rep").select("rep", "bare")
    met = several.toDF("rep", "bx").join(several.toDF("rep", "by"), "rep").where("bx < by").select(F.col("rep").alias("a"), F.col("rep").alias("b"), "bx", "by")
    within = met.join(x, ["a", "bx"]).join(y, ["b", "by"]).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(texts: DataFrame, threshold: float, target_recall: float = 0.92) -> DataFrame:
    """(doc, rep, group_id): every text with a word, the smallest id with its word set, and the smallest id of all texts
    linked to it directly or over others by pairs beyond the threshold; a text without a partner is its own group.

    Groups come from the pairs of representatives, so a set of copies of any size costs no pairs.
    """
    pairs, members = similar_sets(texts, threshold, target_recall)
    groups = connected_groups(pairs, "a", "b").toDF("rep", "found")
    reps = members.select("rep").distinct().join(groups, "rep", "left").select("rep", F.coalesce("found", "rep").alias("group_id"))
    return members.join(reps, "rep").select("doc", "rep", "group_id")
