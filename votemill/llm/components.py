"""Connected components of an edge table, by contraction in a random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill import runtime

#: Edges a task works on when a round is written: a small round is one file, not one for each partition.
EDGES = 200_000


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that has an edge; ``comp`` is one of the component's nodes.

    In each round every node joins the neighbour (or itself) that comes first
    in that round's random order, and edges are redrawn between the nodes
    joined; a constant share of nodes disappears each time, so chains end in
    a logarithmic number of rounds.  Each round is written to the shared
    folder.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = runtime.materialize(edges, "edges")
    tasks = all_tasks = _tasks(left := edges.count())
    labels = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("comp"))
    labels = runtime.materialize(labels.coalesce(all_tasks), "labels")
    turn = 0
    while left:
        turn += 1
        both = edges.union(edges.select("b", "a"))
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("order"), F.col(c).alias("node"))
        joined = both.groupBy("a").agg(F.least(F.min(place("b")), F.first(place("a"))).alias("first")).select(F.col("a").alias("old"), F.col("first.node").alias("new"))
        joined = runtime.materialize(joined.coalesce(tasks), "joined")
        labels = runtime.materialize(labels.join(joined, labels.comp == joined.old, "left").select("node", F.coalesce("new", "comp").alias("comp")).coalesce(all_tasks), "labels")
        to_a, to_b = joined.select(F.col("old").alias("a"), F.col("new").alias("x")), joined.select(F.col("old").alias("b"), F.col("new").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("x <> y")
        edges = runtime.materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(tasks), "edges")
        tasks = _tasks(left := edges.count())
    return labels


def _tasks(edges: int) -> int:
    return max(1, -(-edges // EDGES))
