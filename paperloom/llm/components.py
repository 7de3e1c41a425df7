"""Connected components of an edge table, by alternating large and small stars.

Each round is two groupings and joins on a node. A node with very many neighbours is neither
gathered nor dealt to one task: the least neighbours of such heavy nodes, HEAVY_NODES of them at
most, are broadcast, and only the edges of other nodes are joined by shuffle. Rounds are written
to the shared folder and the one before is deleted, so the lineage stays short; nothing but two
counts per round comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, write_table

#: A node is heavy with more than LIGHT neighbours, or more than its share of edges beyond which
#: there can be no more than HEAVY_NODES of them (24 bytes each).
LIGHT, HEAVY_NODES = 100, 400_000


def _with_least(edges: DataFrame, n_edges: int, self_too: bool) -> DataFrame:
    """edges (u, v) with m, the least v of u (or u itself, with self_too)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.withColumn("m", F.least("m", "u")) if self_too else least
    limit = max(LIGHT, -(-n_edges // HEAVY_NODES))
    heavy = F.broadcast(least.filter(F.col("n") > limit).select("u", F.col("m").alias("hm")))
    light = least.filter(F.col("n") <= limit).select("u", "m")
    marked = edges.join(heavy, "u", "left")
    done = marked.filter("hm IS NOT NULL").select("u", "v", F.col("hm").alias("m"))
    return done.unionByName(marked.filter("hm IS NULL").drop("hm").join(light, "u"))


def _large(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n_edges, True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down, n_edges, False)
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.groupBy("u").agg(F.min("v").alias("v")))


def connected_components(edges: DataFrame, name: str, max_rounds: int = 40) -> DataFrame:
    """edges (u, v) to (node, root), root the least node of the component; roots too."""
    spark = edges.sparkSession
    path, now = write_table(edges.filter("u <> v").select("u", "v").distinct(), f"{name}-edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    if before[0]:
        for _ in range(max_rounds):
            half_path, half = write_table(_large(now, before[0]).distinct(), f"{name}-half")
            new_path, now = write_table(_small(half, before[0]).distinct(), f"{name}-round")
            remove(spark, path, half_path)
            path, after = new_path, mark(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
