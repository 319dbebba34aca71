"""Graph operators over an edge table (source_id, target_id, relationship_type).

Recursions are level-by-level joins of a frontier, or pointer jumping for all nodes at once; each round is
checkpointed in the shared folder, so the lineage stays short and an executor may be lost. Cycles end a walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import materialize

TYPES = ("DESCENDS_FROM", "BORROWED_FROM", "COGNATE_OF", "SHIFTED_TO", "INFLUENCED_BY")


def of_types(edges: DataFrame, *types: str) -> DataFrame:
    if bad := [t for t in types if t not in TYPES]:
        raise ValueError(f"unknown relationship types {bad}")
    return edges.filter(F.col("relationship_type").isin(*types)) if types else edges


def roots(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, root, depth) of every node with one parent at most, by pointer jumping: rounds grow with the log of depth.

    Of several parents the smallest counts. Nodes on or above a cycle get a null root. Nodes that have reached their
    root leave the rounds; only those on the way join each other, on ids that no two of them share. With max_rounds,
    nodes not done by then get a null root as well.
    """
    parent = of_types(edges, "DESCENDS_FROM").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("root"))
    tops = edges.select(F.col("target_id").alias("id")).distinct().join(parent, "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    open_ = materialize(parent.select("id", "root", F.lit(1).alias("depth")))
    done, left, rounds = tops, open_.count(), 0
    while True:
        rounds += 1
        j = open_.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        met = materialize(open_.join(j, "root", "left"))
        # whoever points to a node that isn't open any more has its root, or that node's root
        end = done.select(F.col("id").alias("root"), F.col("root").alias("top"), F.col("depth").alias("d3"))
        stop = met.filter("r2 is null").select("id", "root", "depth").join(end, "root").select("id", F.col("top").alias("root"), (F.col("depth") + F.col("d3")).alias("depth"))
        done = materialize(done.unionByName(stop))
        open_ = materialize(met.filter("r2 is not null").select("id", F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth")))
        now = open_.count()
        if not now:
            return done
        if now == left or rounds == max_rounds:  # nothing but cycles and what leads into them is left
            return done.unionByName(open_.select("id", F.lit(None).cast(open_.schema["root"].dataType).alias("root"), F.lit(None).cast("int").alias("depth")))
        left = now


def walk(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, id, depth): nodes reached from each start along edges, with the least depth; starts themselves at 0."""
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    front = seen
    step = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct()
    for depth in range(1, max_depth + 1):
        new = front.join(step, "id").select("start", F.col("next").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = materialize(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relationship_type")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "relationship_type").unionByName(reversed_(edges))


def chains(edges: DataFrame, starts: DataFrame, max_depth: int = 20) -> DataFrame:
    """(start, proto, depth, path): for each start the longest chain of parents to a word without one, or to max_depth.

    Of equally long ones the first by its path. A word never comes twice into a chain, so cycles end it.
    """
    step = of_types(edges, "DESCENDS_FROM").select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct()
    front = starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct()
    ends = None
    for depth in range(max_depth + 1):
        # a chain ends where no parent is left that it doesn't have
        more = front.join(step, "id").filter(~F.array_contains("path", F.col("next")))
        done = front if depth == max_depth else front.join(more.select("start", "path").distinct(), ["start", "path"], "left_anti")
        done = done.select("start", "path")
        ends = done if ends is None else ends.unionByName(done)
        if depth == max_depth:
            break
        front = materialize(more.select("start", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path")))
        if front.isEmpty():
            break
    text = F.array_join("path", " > ")
    best = ends.groupBy("start").agg(F.min(F.struct((-F.size("path")).alias("n"), text.alias("path"), F.element_at("path", -1).alias("proto"))).alias("x"))
    return best.select("start", "x.proto", (-F.col("x.n") - 1).alias("depth"), "x.path")


def shortest_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 5, most: int = 10, *types: str) -> DataFrame:
    """(start, id, hops, path): all shortest ways from each start to every word within reach, both directions of an edge,
    at most `most` a pair in order of the path; that limit belongs to the operator.
    """
    step = both_ways(of_types(edges, *types)).select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct()
    seen = starts.select(F.col("id").alias("start"), "id").distinct()
    front = seen.withColumn("path", F.col("id"))
    out = None
    for hops in range(1, max_hops + 1):
        new = front.join(step, "id").select("start", F.col("next").alias("id"), F.concat_ws(" - ", "path", "next").alias("path")).join(seen, ["start", "id"], "left_anti")
        # more than `most` ways to a word aren't carried on: of its ways those first in order stay first
        w = Window.partitionBy("start", "id").orderBy("path")
        front = materialize(new.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("start", "id").distinct())
        level = front.select("start", "id", F.lit(hops).alias("hops"), "path")
        out = level if out is None else out.unionByName(level)
    return out if out is not None else seen.limit(0).select("start", "id", F.lit(0).alias("hops"), F.lit("").alias("path"))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1, *types: str) -> DataFrame:
    """(start, id, depth) of words exactly up to `depth` edges away, both directions, starts aside."""
    return walk(both_ways(of_types(edges, *types)), starts, depth).filter("depth > 0")


def _spread(labels: DataFrame, step: DataFrame) -> DataFrame:
    """labels (id, color) with the smallest color that reaches each id along step (id, next), until nothing changes."""
    while True:
        got = labels.join(step, "id").select(F.col("next").alias("id"), "color")
        new = materialize(labels.unionByName(got).groupBy("id").agg(F.min("color").alias("color")))
        if new.join(labels, ["id", "color"], "left_anti").isEmpty():
            return new
        labels = new


def on_cycles(edges: DataFrame, largest: int | None = None) -> DataFrame:
    """Nodes of cycles of any length: strongly connected components of two nodes or more, and nodes with an edge to themselves.

    Nodes that lose all parents or children are peeled off; in the core that is left, every node takes the smallest id
    that reaches it, and what reaches that id again among the nodes that took it is its component. Components are taken
    out until nothing is left: one row a node, never a pair of nodes. With `largest`, components of more nodes are left out.
    """
    core = materialize(edges.select("source_id", "target_id").distinct())
    found = core.filter("source_id = target_id").select(F.col("source_id").alias("id"))
    core = materialize(core.filter("source_id <> target_id"))
    while True:
        while True:
            nxt = core.join(core.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi")
            nxt = materialize(nxt.join(nxt.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id"))
            if nxt.count() == core.count():
                break
            core = nxt
        if nxt.isEmpty():
            return found.distinct()
        forth = nxt.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"))
        colors = _spread(nxt.select(F.col("source_id").alias("id")).distinct().withColumn("color", F.col("id")), forth)
        # backwards, only along edges inside a color
        ends = nxt.join(colors.select(F.col("id").alias("source_id"), F.col("color").alias("c1")), "source_id").join(colors.select(F.col("id").alias("target_id"), F.col("color").alias("c2")), "target_id")
        back = materialize(ends.filter("c1 = c2").select(F.col("target_id").alias("id"), F.col("source_id").alias("next")))
        part = _spread(colors.filter("id = color"), back)
        size = part.groupBy("color").agg(F.count("*").alias("n")).filter("n > 1" if largest is None else f"n between 2 and {largest}")
        found = materialize(found.unionByName(part.join(size, "color").select("id")))
        gone = part.select("id")
        core = materialize(nxt.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("source_id", "target_id"))


def orphan_nodes(nodes: DataFrame, *references: DataFrame) -> DataFrame:
    for r in references:
        nodes = nodes.join(r, nodes["node_id"] == r[r.columns[0]], "left_anti")
    return nodes
