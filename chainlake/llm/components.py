"""Problem 3: one group identifier for everything that is linked, directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.storage import Scratch


def _rank(vertex: Column, seed: int) -> Column:
    """A fresh pseudo-random order of the vertices in every round; the vertex itself settles equal hashes."""
    return F.struct(F.xxhash64(vertex, F.lit(seed)).alias("h"), vertex.alias("v"))


def connected_groups(
    links: DataFrame, left: str, right: str, scratch: Scratch | None = None, seed: int = 20_011, max_rounds: int = 200
) -> DataFrame:
    """Vertices of an undirected graph with the smallest vertex of their component.

    Randomised graph contraction: in each round every vertex hooks to the neighbour (or itself) that
    comes first in a fresh random order, the edges are relabelled with the chosen vertices, loops
    dropped and duplicates removed. The expected number of vertices falls by a constant factor a
    round whatever the shape of the graph, so long chains and huge stars both end after O(log n)
    rounds. The rounds' mappings are then composed from the last to the first.

    Hubs: the choice is a min(), which combines on the map side; the relabelling joins are between
    the edges and a table that is unique by vertex, where adaptive execution splits a hot vertex.
    Edges and mappings are written to the shared folder each round, so a lost executor costs one round.

    Returns (vertex, group_id). A vertex linked only to itself is its own group. Rows with a null end
    are ignored, repeated rows and both directions are the same link, extra columns are ignored, and
    no links give no rows.
    """
    spark = links.sparkSession
    scratch = scratch or Scratch(spark, "components")
    both = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    start = scratch.save(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    edges = start.where("a <> b")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select(
            F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
        )
        first = ends.groupBy("v").agg(F.min(_rank(F.col("w"), seed + k)).alias("n"))
        hook = first.select("v", F.least(F.col("n"), _rank(F.col("v"), seed + k))["v"].alias("r"))
        hook = scratch.save(hook, f"map{k}")
        maps.append(hook)
        new = (
            edges.join(hook.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a")
            .join(hook.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        edges = scratch.save(new, f"edges{k + 1}")
        if k:
            scratch.drop(f"edges{k}")
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    vertices = start.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    if not maps:
        return vertices.select("vertex", F.col("vertex").alias("group_id"))
    whole = maps[-1]
    for k in range(len(maps) - 2, -1, -1):
        later = whole.select(F.col("v").alias("r"), F.col("r").alias("r2"))
        whole = maps[k].join(later, "r", "left").select("v", F.coalesce("r2", "r").alias("r"))
        if k % 4 == 0:
            whole = scratch.save(whole, f"whole{k}")
    smallest = whole.groupBy("r").agg(F.min("v").alias("least_v"))
    named = whole.join(smallest, "r").select(F.col("v").alias("vertex"), F.least("least_v", "r").alias("group_id"))
    loops = start.where("a = b").select(F.col("a").alias("vertex")).join(named.select("vertex"), "vertex", "left_anti")
    return named.unionByName(loops.select("vertex", F.col("vertex").alias("group_id")))
