"""Connected components of a graph of any size, with steps that only group and join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import collect_garbage, discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, root``: the smallest node that each node of an edge reaches.

    Large-star and small-star rounds: every node points its larger neighbours, then its smaller ones,
    to the smallest it knows, until nothing changes. Each round writes its edges, so lineage stays
    short. Loops and repeated edges do no harm; no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    graph = stored(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        last, graph = graph, stored(_small_star(_large_star(graph)), "edges")
        discard(last)
        collect_garbage(edges.sparkSession)  # a round leaves the shuffle files of half a dozen exchanges
        now = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    members = graph.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return members.union(roots)


def _large_star(graph: DataFrame) -> DataFrame:
    both = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(graph: DataFrame) -> DataFrame:
    least = graph.groupBy("u").agg(F.min("v").alias("m"))
    pointed = graph.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pointed.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
