"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import shared

MAX_ROUNDS = 60
#: Edges for one task of a round; a small state is not spread over many tasks and files.
ROWS_A_TASK = 50_000


def _least(rows: DataFrame, large: bool) -> DataFrame:
    """(a, m): the smallest neighbour of every node. Of a large state it is saved, since a side that was just grouped
    keeps adaptive execution from splitting a hub's rows on the other."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"))
    return shared.saved(least, "least") if large else least


def _large_star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, large).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, large: bool) -> DataFrame:
    """A node and its smaller neighbours are all tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = shared.saved(down, "down") if large else down
    least = _least(down, large)
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(key, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round is written to the shared folder, so no lineage grows and a lost executor costs
    one round at most. Nodes of a hub are summed up before they are shuffled; where the state is
    more than one task's, the sums are saved before they are joined, so that adaptive execution
    splits the hub's rows. Null ends are ignored.
    """
    state = shared.saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    n = state.count()
    was, width = None, 1 + n // ROWS_A_TASK
    for _ in range(MAX_ROUNDS if n else 0):
        step = _small_star(_large_star(state, n > ROWS_A_TASK), n > ROWS_A_TASK).where("a <> b").distinct()
        before, state = state, shared.saved(step.coalesce(width), "edges")
        shared.drop(before)
        seen = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == was or not seen.n:
            break
        was = seen
    else:
        if n:
            raise RuntimeError("the components did not settle")
    members = state.select(F.col("a").alias("key"), F.col("b").alias("component"))
    return members.unionByName(state.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())
