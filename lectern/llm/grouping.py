"""Consolidating pairwise matches into groups by deterministic Boruvka hooking.

Every component selects its smallest outgoing edge. With edges ordered by (smaller label, larger label) that edge leads
to the smallest neighbouring label, so hooking is one aggregation with map-side combine, and the only cycles are
mutual choices, which the smaller label wins. Trees collapse by pointer doubling, edges are relabelled and
deduplicated, and rounds go on until no edge is left; each round at least halves the number of components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scale import cut, release, skew_safe_join


def _hook(edges: DataFrame) -> DataFrame:
    """(c, p): the smallest neighbour of each component, mutual choices settled in favour of the smaller label."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("p")), F.struct(F.col("v").alias("c"), F.col("u").alias("p")))).alias("e")).select("e.*")
    chosen = cut(both.groupBy("c").agg(F.min("p").alias("p")))
    theirs = chosen.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    tree = cut(skew_safe_join(chosen, "p", theirs, chosen.count()).select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
    release(chosen)
    return tree


def _collapse(tree: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at its root."""
    total = tree.count()
    while True:
        up = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jumped = cut(skew_safe_join(tree, "p", up, total).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        release(tree)
        tree = jumped.select("c", "p")
        if jumped.where("moved").isEmpty():
            return tree


def connected_groups(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, label): for each node of ``pairs`` the smallest node it is linked to directly or indirectly.

    Null ends, self pairs, repeated and reversed pairs are allowed and add nothing; a node only in self pairs has no
    row. No pairs give no rows. A hub with any share of all pairs is met by broadcasts of at most a fixed number of
    hot labels. Labels compare as numbers (long).
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    edges = cut(pairs.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    rounds: list[DataFrame] = []
    n = edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while n:
        tree = _collapse(_hook(edges))
        rounds.append(tree)
        half = cut(skew_safe_join(edges, "u", tree.toDF("u", "a"), n).select("a", "v"))
        moved = skew_safe_join(half, "v", tree.toDF("v", "b"), n)
        fewer = cut(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        release(edges)
        release(half)
        edges = fewer
        n = edges.count()
    out = rounds.pop()
    while rounds:  # from the few labels of the last round back to all nodes
        tree = rounds.pop()
        up = out.select(F.col("c").alias("p"), F.col("p").alias("top"))
        met = skew_safe_join(tree, "p", up, tree.count()).select("c", F.col("top").alias("p"))
        final = cut(met.unionByName(tree.join(up.select("p"), "p", "left_anti").select("c", "p")))  # labels done earlier stay
        release(out)
        release(tree)
        out = final
    return out.select(F.col("c").alias("node"), F.col("p").alias("label"))


#: Group nodes are numbered from here, above every id, so that the smallest node of a component is always an id.
GROUP_BASE = 1 << 40


def question_groups(matches: DataFrame, questions: DataFrame, least_score: float = 0.7) -> DataFrame:
    """(group_id, question_id): questions linked by a match of at least ``least_score`` or by one repeat_group_id.

    Null scores and null ids link nothing. A repeat group is a node of its own, so that a group of any size costs one
    link a member. Ids that questions no longer holds count. A question linked to no other has no row; the smallest
    id of each group has one.
    """
    scored = matches.where((F.col("score") >= least_score) & (F.col("left_id") != F.col("right_id"))).select(F.col("left_id").cast("long").alias("left"), F.col("right_id").cast("long").alias("right"))
    earlier = questions.where(F.col("repeat_group_id").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("left"), (F.col("repeat_group_id").cast("long") + F.lit(GROUP_BASE + (1 << 32))).alias("right"))
    found = connected_groups(scored.unionByName(earlier)).where(F.col("node") < GROUP_BASE)
    rest = found.where("node <> label").select(F.col("label").cast("int").alias("group_id"), F.col("node").cast("int").alias("question_id"))
    heads = rest.select("group_id", F.col("group_id").alias("question_id")).distinct()
    return rest.unionByName(heads)
