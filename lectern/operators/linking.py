"""Links by embedding vectors: topic of a question, repeats within a topic, and groups of linked rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.params import DEFAULT
from lectern.scale import cut, dense_ids, release, skew_safe_join

#: Topic vectors sent to the tasks at a time, and vectors of one block in the search for repeats.
TOPIC_BLOCK, BLOCK = 4096, 1024
#: Edges that one task unites.
ONE_TASK_EDGES = 2_000_000


def topic_text(name: Column, unit: Column) -> Column:
    """What is embedded of a topic."""
    return F.concat(name, F.lit(". "), unit)


def question_text(text: Column, cleaned: Column) -> Column:
    """What is embedded of a question: the cleaned text where there is one."""
    return F.coalesce(F.nullif(cleaned, F.lit("")), text)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1; a zero vector stays zero."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column.to_pylist()]) if len(column) else np.zeros((0, 1))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def assign_topics(items: DataFrame, topics: DataFrame, threshold: float = DEFAULT.topic_threshold) -> DataFrame:
    """(id, topic_id, score): the most similar topic of each item, where its cosine reaches the threshold.

    Both tables are (id, vector); null ids and vectors take no part, ties go to the smaller topic id. Topic vectors go
    to the tasks in blocks of TOPIC_BLOCK, of which each item sees all; the best of the blocks is kept by an aggregation.
    """
    vectors = topics.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    numbered = cut(dense_ids(vectors, ["id"], "n", 0).join(vectors, "id"))
    blocks = -(-numbered.count() // TOPIC_BLOCK)
    rows = items.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    best = None
    for b in range(blocks):
        held = numbered.where(F.floor(F.col("n") / TOPIC_BLOCK) == b).orderBy("n").toArrow()  # at most TOPIC_BLOCK rows
        ids, matrix = held["id"].to_numpy(), _matrix(held["vector"].combine_chunks())

        def score(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    s = _matrix(batch["vector"]) @ matrix.T
                    at = s.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids[at]), pa.array(s[np.arange(len(at)), at])], names=["id", "topic_id", "score"])

        part = rows.mapInArrow(score, "id long, topic_id long, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return rows.select("id", F.lit(None).cast("long").alias("topic_id"), F.lit(None).cast("double").alias("score")).limit(0)
    if blocks > 1:
        best = best.groupBy("id").agg(F.max(F.struct("score", (-F.col("topic_id")).alias("t"))).alias("m")).select("id", (-F.col("m.t")).alias("topic_id"), "m.score")
    return best.where(F.col("score") >= threshold)


def repeat_pairs(items: DataFrame, threshold: float = DEFAULT.repeat_threshold, block: int = BLOCK) -> DataFrame:
    """(topic_id, left, right, score), left < right: items of one topic whose cosine reaches the threshold.

    Input (id, topic_id, vector); rows with a null take no part. A topic's items are spread over blocks by a hash, and
    each pair of blocks is one group of at most two blocks, whatever the size of the topic; only pairs that reach the
    threshold leave it.
    """
    rows = items.where("id is not null and topic_id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("topic_id").cast("long").alias("topic_id"), "vector")
    sizes = rows.groupBy("topic_id").agg(F.count("*").alias("n")).where("n > 1").select("topic_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    spread = rows.join(sizes, "topic_id").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ways = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
    spread = spread.select("topic_id", "id", "vector", "b", F.explode(ways).alias("w")).select("topic_id", "id", "vector", "b", "w.i", "w.j")

    def meet(table: pa.Table) -> pa.Table:
        ids, b, vectors = table["id"].to_numpy(), table["b"].to_numpy(), _matrix(table["vector"].combine_chunks())
        i, j, topic = table["i"][0].as_py(), table["j"][0].as_py(), table["topic_id"][0].as_py()
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        s = vectors[left] @ vectors[right].T
        x, y = np.nonzero(s >= threshold)
        if i == j:
            keep = ids[left[x]] < ids[right[y]]
            x, y = x[keep], y[keep]
        a, c = ids[left[x]], ids[right[y]]
        return pa.table({"topic_id": np.full(len(a), topic), "left": np.minimum(a, c), "right": np.maximum(a, c), "score": s[x, y]})

    return spread.groupBy("topic_id", "i", "j").applyInArrow(meet, "topic_id long, left long, right long, score double")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of edges (u, v) held in one task: labels sink to the smallest end, paths are halved, until none moves."""
    held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
    cuts = np.cumsum([len(x) for pair in held for x in pair])[:-1]
    ends = np.split(at, cuts)
    u, v = np.concatenate(ends[::2]), np.concatenate(ends[1::2])
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(pairs: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): the smallest node reachable over (left, right) pairs; self pairs and nulls add nothing.

    Edges that fit a task are united there. More are contracted first: each node hooks to its smallest neighbour if that is
    smaller, paths are shortened by doubling, and edges are relabelled and deduplicated. Joins are safe from hot nodes,
    and each round is written to the shared folder.
    """
    u, v = F.col("left").cast("long"), F.col("right").cast("long")
    edges = cut(pairs.where("left <> right").select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    trees: list[DataFrame] = []
    while (n := edges.count()) > one_task:
        tree = cut(edges.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("p")))  # hooks to smaller nodes alone, so there is no cycle
        total, moving = tree.count(), True
        while moving:
            up = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            met = skew_safe_join(tree, "p", up, total).select("c", F.col("pp").alias("p"))
            jumped = cut(met.withColumn("moved", F.lit(True)).unionByName(tree.join(up.select("p"), "p", "left_anti").select("c", "p").withColumn("moved", F.lit(False))))
            release(tree)
            tree, moving = jumped.select("c", "p"), not jumped.where("moved").isEmpty()
        trees.append(tree)
        for end in ("u", "v"):
            named = tree.select(F.col("c").alias(end), F.col("p").alias("r"))
            stay = edges.join(named.select(end), end, "left_anti")
            moved = skew_safe_join(edges, end, named, n).withColumn(end, F.col("r")).select("u", "v").unionByName(stay.select("u", "v"))
            fewer = cut(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
            release(edges)
            edges = fewer
    labels = cut(edges.coalesce(1).mapInArrow(_united, "node long, root long"))
    release(edges)
    for tree in reversed(trees):
        top = labels.select(F.col("node").alias("p"), "root")
        met = skew_safe_join(tree, "p", top, tree.count()).select(F.col("c").alias("node"), "root")
        alone = tree.join(top.select("p"), "p", "left_anti")
        own = alone.select(F.col("c").alias("node"), F.col("p").alias("root")).unionByName(alone.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
        following = cut(labels.unionByName(met).unionByName(own))
        release(labels)
        release(tree)
        labels = following
    return labels


def repeat_groups(items: DataFrame, pairs: DataFrame, last_group: int = 0) -> DataFrame:
    """(id, topic_id, repeat_group_id): linked items of a topic, numbered on from ``last_group`` by topic and smallest id."""
    found = components(pairs.select("left", "right")).join(items.select(F.col("id").cast("long").alias("node"), F.col("topic_id").cast("long").alias("topic_id")), "node")
    numbers = dense_ids(found, ["topic_id", "root"], "repeat_group_id", last_group + 1)
    return found.join(numbers, ["topic_id", "root"]).select(F.col("node").alias("id"), "topic_id", "repeat_group_id")


def unassigned(questions: DataFrame) -> DataFrame:
    """Questions without a topic."""
    return questions.where(F.col("topic_id").isNull())


def last_group(questions: DataFrame) -> int:
    """The largest repeat_group_id so far, or 0."""
    return int(questions.agg(F.coalesce(F.max("repeat_group_id"), F.lit(0))).first()[0])


def keep_first(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first row by ``order`` of each equal ``keys``: an aggregation with map-side combine, whatever the copies."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)
