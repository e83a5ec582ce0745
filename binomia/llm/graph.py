"""Connected components by randomized contraction.

Each round every node takes the neighbour (or itself) that comes first in an order drawn anew, and the graph is contracted
along these choices. Whatever its shape, a round leaves at most three quarters of the nodes on average, so the rounds are
logarithmic in the largest component and all of them together cost about as much as the first few. The choices of the rounds are
then composed backwards into a label for each node. Minima are aggregated before the shuffle and joins are plain, so a hub
that holds a third of all links is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _order(node: Column, turn: int) -> Column:
    """A place in the order of this round; a hash of 64 bits that no two nodes share."""
    return F.xxhash64(node, F.lit(turn))


def _contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(node, rep) for each node, and the links between different representatives."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min(_order(F.col("v"), turn)).alias("least"), F.min_by("v", _order(F.col("v"), turn)).alias("v"))
    own = F.when(_order(F.col("u"), turn) < F.col("least"), F.col("u")).otherwise(F.col("v"))
    reps = written(first.select(F.col("u").alias("node"), own.alias("rep")), "graph-reps")
    a, b = reps.select(F.col("node").alias("u"), F.col("rep").alias("ru")), reps.select(F.col("node").alias("v"), F.col("rep").alias("rv"))
    left = edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
    return reps, written(left, "graph-edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (u, v): label is the smallest node of its component. Rows with a null end and
    links of a node to itself count for nothing."""
    left = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "graph-edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        reps, rest = _contracted(left, len(rounds))
        dropped(left)
        rounds.append(reps)
        left = rest
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    dropped(left)
    found = rounds.pop()
    while rounds:
        reps = rounds.pop()
        after = reps.join(found.select(F.col("node").alias("rep"), F.col("rep").alias("far")), "rep", "left")
        new = written(after.select("node", F.coalesce("far", "rep").alias("rep")), "graph-labels")
        dropped(reps)
        dropped(found)
        found = new
    least = found.groupBy("rep").agg(F.min("node").alias("label"))
    out = written(found.join(least, "rep").select("node", "label"), "graph-components")
    dropped(found)
    return out
