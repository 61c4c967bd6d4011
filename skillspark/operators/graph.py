"""Groups of linked nodes for the relational pipeline, by randomised contraction.

A round gives every node a hash that is new in each round and lets it join the
neighbour (or itself) with the smallest one; the joined nodes become the nodes
of a smaller graph. In expectation a third of the nodes at least goes with each
round, whatever the shape, so a chain of a million nodes takes some thirty
rounds. The way back composes the rounds, from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillspark.session import cut_lineage


#: Rounds of the way back in one plan.
JOINS_PER_PLAN = 5


def both_ways(a: str, b: str) -> Column:
    """(a, b) and, where they differ, (b, a), as an array for inline: a union would hold the plan of the pairs twice."""
    there, back = F.struct(a, b), F.struct(F.col(b).alias(a), F.col(a).alias(b))
    return F.when(F.col(a) == F.col(b), F.array(there)).otherwise(F.array(there, back))


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(node -> rep, edges between representatives) of edges(a, b), each held in both directions."""
    order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))
    # the smallest neighbour is found map-side first, so the centre of a star is no hot key
    nearest = edges.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
    reps = cut_lineage(nearest.select("node", F.least("m", order("node")).getField("id").alias("rep")))
    of = lambda c: reps.select(F.col("node").alias(c), F.col("rep").alias(f"r{c}"))
    moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return reps, cut_lineage(moved.where("a <> b").distinct())


def link_groups(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, group): every node on edges(a, b) with the smallest node it is linked to, directly or not.

    Null ends and loops link nothing; extra columns are ignored. No edges give
    no rows. Rounds grow with the logarithm of the number of nodes; RuntimeError
    if max_rounds do not suffice.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    rest = cut_lineage(clean.select(F.inline(both_ways("a", "b"))).distinct())
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
        reps, rest = _contract(rest, len(rounds))
        rounds.append(reps)
    if not rounds:
        return clean.select(F.col("a").alias("node"), F.col("a").alias("group"))
    labels = rounds.pop()
    for back in range(len(rounds), 0, -1):
        # a node that lost all its edges in this round is missing from the next one and stands for itself
        later = labels.select(F.col("node").alias("rep"), F.col("rep").alias("top"))
        labels = rounds[back - 1].join(later, "rep", "left").select("node", F.coalesce("top", "rep").alias("rep"))
        if back % JOINS_PER_PLAN == 1:  # rounds shrink fast, so several of them are one plan
            labels = cut_lineage(labels)
    least = labels.groupBy("rep").agg(F.min("node").alias("group"))
    return labels.join(least, "rep").select("node", "group")
