"""Connected components of a table of links, by alternating stars.

A large star links a node's larger neighbours to its smallest one, a small
star its smaller neighbours; in the end every node hangs on its component's
smallest node. Links stay in tables: each step is an aggregate and a join, so
hubs are pre-aggregated and their joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links to a partition of what is kept between rounds.
PARTITION_ROWS = 20_000


#: Up to so many links the least neighbours, a row a node, are broadcast, so that a hub's links stay where they are.
#: Beyond, a hub's partition is one that adaptive execution splits: the other side has one row for it.
BROADCAST_LINKS = 200_000


def star(directed: DataFrame, larger_only: bool, few: bool) -> DataFrame:
    """directed: (a, b). For each a with the least m of itself and its b: links from its b (larger_only: those above a) to m."""
    least = directed.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    linked = directed.join(F.broadcast(least) if few else least, F.col("a") == F.col("_a")).withColumn("_m", F.least("_m", "a"))
    if larger_only:
        return linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (a long, b long) -> (node, root) for every node that isn't its component's smallest."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, rows = None, edges.count()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        few = rows <= BROADCAST_LINKS
        large = star(both, True, few).where("a <> b").distinct()
        small = star(large, False, few).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # Few links are kept in few files.
        edges = cut(small.coalesce(rows // PARTITION_ROWS + 1))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, rows = now, now[0]
    raise RuntimeError("components did not settle")
