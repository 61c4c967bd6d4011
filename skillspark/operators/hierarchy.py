"""Problem 7: parent-child rows unfolded into paths, depths, roots and descendant counts.

Frontier joins from the roots. Each join takes in a block of levels twice as
thick as the one before: beside the frontier every node that is not reached
yet knows its ancestor that many levels up and the path in between. So a chain
of a thousand levels takes ten joins, not a thousand. What no root reaches runs
into a circle: there every node has exactly one parent, so jumps of doubled
length shrink the set of nodes that are jumped to until only the circles are
left. These then act as roots for the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillspark.session import cut_lineage

SEPARATOR = " > "


def latest_parents(rows: DataFrame, node: str = "skill_id", parent: str = "parent_skill_id", at: str = "loaded_at") -> DataFrame:
    """(id, parent): one row per node by its latest row; parent null where it is empty or no node of the table.

    Rows without a node id are left out. Rows of the same time count by the
    greatest parent id; a row without time is older than any other.
    """
    latest = (
        rows.where(F.col(node).isNotNull())
        .select(F.col(node).alias("id"), F.struct(F.col(at).alias("a"), F.nullif(F.col(parent), F.lit("")).alias("p")).alias("v"))
        .groupBy("id")
        .agg(F.max("v").alias("v"))
        .select("id", F.col("v.p").alias("parent"))
    )
    known = latest.select(F.col("id").alias("kid"))
    return latest.join(known, F.col("parent") == F.col("kid"), "left").select("id", F.col("kid").alias("parent"))


def _descend(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """start(id, root_id, depth, path array) and all below it, a block of levels a join."""
    reached = [start]
    frontier = start
    # up: the ancestor `thick` levels up; way: the nodes below it down to the node itself
    rest = edges.select("id", F.col("parent").alias("up"), F.array("id").alias("way"))
    thick = 1
    while True:
        known = frontier.select(F.col("id").alias("up"), "root_id", F.col("depth").alias("d"), F.col("path").alias("p"))
        block = cut_lineage(
            rest.join(known, "up").select("id", "root_id", (F.col("d") + thick).alias("depth"), F.concat("p", "way").alias("path"))
        )
        if block.isEmpty():  # depths have no gaps: nothing lies deeper
            break
        if thick > max_depth:
            raise RuntimeError(f"deeper than {max_depth} levels")
        reached.append(block)
        deeper = rest.join(block.select("id"), "id", "left_anti")
        above = rest.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("way").alias("way2"))
        rest = cut_lineage(deeper.join(above, "up").select("id", F.col("up2").alias("up"), F.concat("way2", "way").alias("way")))
        frontier = reduce(DataFrame.unionByName, reached)
        thick *= 2
    return reduce(DataFrame.unionByName, reached)


def _circles(edges: DataFrame) -> DataFrame:
    """(id, root_id, size): the nodes on circles among edges in which every node has a parent in the set."""
    jump = cut_lineage(edges.select("id", F.col("parent").alias("to"), F.col("parent").alias("low"), F.lit(1).cast("long").alias("n")))
    left = -1
    while True:
        hit = jump.select("to").distinct()
        n = hit.count()
        if n == left:  # the jump maps this set onto itself: all of it lies on circles
            break
        left = n
        jump = cut_lineage(_double(jump))
    ring = cut_lineage(edges.join(hit.select(F.col("to").alias("id")), "id", "left_semi").select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low")))
    while True:  # smallest id met on the way round, by doubled jumps
        nxt = ring.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = cut_lineage(ring.join(nxt, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        ring = new.drop("moved")
        if not moved:
            break
    return ring.select("id", F.col("low").alias("root_id"))


def _unreached(inner: DataFrame) -> DataFrame:
    """(id): the nodes that no root reaches. Jumps of doubled length leave out whoever they take past a root; when a jump leaves out nobody, the rest runs into circles."""
    jump = inner.select("id", F.col("parent").alias("to"))
    left = jump.count()
    while left:
        jump = cut_lineage(_double(jump))
        now = jump.count()
        if now == left:
            break
        left = now
    return jump.select("id")


def _double(jump: DataFrame) -> DataFrame:
    nxt = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"))
    return jump.join(nxt, "to").select("id", F.col("to2").alias("to"))


def unfold(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(skill_id, root_id, depth, path, n_descendants, in_cycle) as unfold_paths gives it, the path as one text."""
    return unfold_paths(edges, max_depth).withColumn("path", F.array_join("path", SEPARATOR))


def unfold_paths(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(skill_id, root_id, depth, path, n_descendants, in_cycle), one row per id of edges(id, parent); path is the array of ids from the root.

    parent is null for roots and otherwise an id of the table. A node that is
    its own parent is a circle of one. No rows give no rows. Raises
    RuntimeError beyond max_depth levels.
    """
    edges = cut_lineage(edges)
    roots = edges.where("parent IS NULL").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    inner = edges.where("parent IS NOT NULL")
    # apart from the trees first: paths that go round in a circle would grow with every jump
    apart = cut_lineage(_unreached(inner))
    nodes = _descend(roots, inner.join(apart, "id", "left_anti"), max_depth).withColumn("in_cycle", F.lit(0))
    if not apart.isEmpty():
        lost = cut_lineage(inner.join(apart, "id", "left_semi"))
        on_ring = cut_lineage(_circles(lost))
        start = on_ring.select("id", "root_id", F.lit(0).alias("depth"), F.array("id").alias("path"))
        hanging = lost.join(on_ring.select("id"), "id", "left_anti")
        nodes = nodes.unionByName(_descend(start, hanging, max_depth).withColumn("in_cycle", F.lit(1)))
    nodes = cut_lineage(nodes)
    # ancestor pairs, counted before they are shuffled; who stands on a circle has all of it below
    above = nodes.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("id"), "in_cycle")
    below = above.groupBy("id").agg(F.count("*").alias("n"))
    ring_size = nodes.where("in_cycle = 1").groupBy("root_id").agg((F.count("*") - 1).alias("round"))
    return (
        nodes.join(below, "id", "left")
        .join(ring_size, "root_id", "left")
        .select(
            F.col("id").alias("skill_id"),
            "root_id",
            F.col("depth").cast("int").alias("depth"),
            "path",
            F.when((F.col("in_cycle") == 1) & (F.col("depth") == 0), F.col("round"))
            .otherwise(F.coalesce("n", F.lit(0)))
            .cast("int")
            .alias("n_descendants"),
            F.col("in_cycle").cast("int").alias("in_cycle"),
        )
    )


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, depth) of unfold_paths, each node with itself at depth 0."""
    steps = nodes.select(F.posexplode("path").alias("pos", "ancestor_id"), F.col("skill_id").alias("descendant_id"), F.size("path").alias("n"))
    return steps.select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).cast("int").alias("depth"))
