"""Connected components by contraction, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import written


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for the nodes of ``edges(u long, v long)`` that are not their own root.

    In each round a node moves to the neighbour whose hash is smallest and below its own;
    edges follow their ends, and those within one node go. Hashes order nodes at random,
    so the number of nodes falls by a factor each round, hubs and long chains alike.
    Minima combine before the shuffle, joins by a hub's key are split as skewed joins, and
    each round's tables lie in the shared folder.
    """
    rank = lambda name: F.struct(F.xxhash64(name).alias("hash"), F.col(name).alias("node"))
    left = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), label)
    moves: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        move = written(
            near.select(F.col("u").alias("node"), F.least("best", rank("u"))["node"].alias("root")),
            label,
        )
        moves.append(move)
        ends = (
            left.join(move.toDF("u", "p"), "u").join(move.toDF("v", "q"), "v").where("p <> q")
            .select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
        )
        left = written(ends, label)
    if not moves:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        later = roots.toDF("root", "next")
        onward = move.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = written(onward, label)
    return roots.where("node <> root")
