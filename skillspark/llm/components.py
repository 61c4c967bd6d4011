"""Problem 3: group identifiers for records joined by pairwise matches.

Alternating large-star and small-star rewrites of the edge list. A large-star
step links every larger neighbour of a node to the smallest node it knows, a
small-star step links the smaller ones; when a round changes nothing each edge
points at the smallest number of its component.

The smallest neighbour of a node is a map-side combined aggregate. Giving it
back to the edges is a join on the node, where the centre of a large star may
hold a large part of all rows. Few nodes can hold more rows than a task of the
shuffle gets on average; those are joined by broadcast, all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillspark.session import cut_lineage, max_heavy_keys

#: Rows of one node that a task takes with ease.
TASK_ROWS = 1_000_000


def match_edges(pairs: DataFrame, left: str = "left_no", right: str = "right_no", verdict: str = "is_match") -> DataFrame:
    """Distinct undirected links (u > v) of the rows with a true verdict; null ends, null verdicts and self pairs link nothing."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    return (
        pairs.where(F.col(verdict) & a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )


def _with_min(ends: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """ends(u, v, moved) plus m of least(u, m, n); u on more than limit rows are not shuffled."""
    if limit is None:
        return ends.join(least.select("u", "m"), "u")
    heavy = least.where(F.col("n") > limit).select("u", "m")
    light = least.where(F.col("n") <= limit).select("u", "m")
    rest = ends.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(light, "u")
    return ends.join(F.broadcast(heavy), "u").unionByName(rest)


def _placed(ends: DataFrame, limit: int | None) -> DataFrame:
    """ends by u in one shuffle that the aggregates and joins on u share; where a u may be heavy they shuffle by themselves, pre-aggregated."""
    return ends.repartition("u") if limit is None else ends


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.max("moved").alias("moved"))


def large_star(edges: DataFrame, limit: int | None) -> DataFrame:
    """Every neighbour v > u of u becomes linked to the smallest of u and its neighbours; moved where that is not u."""
    both = _placed(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), limit)
    least = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n")
    larger = _with_min(both, least, limit).where(F.col("v") > F.col("u"))
    return _distinct(_placed(larger.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved")), limit))


def small_star(edges: DataFrame, limit: int | None) -> DataFrame:
    """u and its smaller neighbours become linked to the smallest of them (edges hold u > v); moved where an edge is new."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.max("moved").alias("moved"))
    others = _with_min(edges.select("u", "v"), least, limit).where(F.col("v") != F.col("m"))
    return _distinct(
        others.select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")).unionByName(least.select("u", F.col("m").alias("v"), "moved"))
    )


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(rec_no, group_id) for every number on an edge; group_id is the component's smallest number.

    edges: columns u, v (bigint, u > v, distinct), as match_edges gives them.
    No edges give no rows. Raises RuntimeError if max_rounds do not suffice
    (rounds grow with the logarithm of the largest component).
    """
    most = max_heavy_keys(edges.sparkSession)
    edges = cut_lineage(edges)
    rows = edges.count()
    for _ in range(max_rounds):
        # less than `most` nodes have more of the 2 * rows ends than this
        limit = max(TASK_ROWS, 2 * rows // most) if 2 * rows > TASK_ROWS else None
        edges = cut_lineage(small_star(large_star(edges, limit), limit))
        # a round that moves nothing gives back the edges it was given
        state = edges.agg(F.count("*").alias("rows"), F.max("moved").alias("moved")).first()
        rows = state["rows"]
        if not state["moved"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: each u has exactly one edge, to the smallest number of its component.
    roots = edges.select(F.col("v").alias("rec_no"), F.col("v").alias("group_id")).distinct()
    return edges.select(F.col("u").alias("rec_no"), F.col("v").alias("group_id")).unionByName(roots)


def match_groups(pairs: DataFrame) -> DataFrame:
    """Groups of two or more records of a pair table: (rec_no, group_id).

    Extra columns are ignored. Nulls, self pairs and rows without a true
    verdict link nothing; repeated rows and both directions count once.
    """
    return connected_components(match_edges(pairs))
