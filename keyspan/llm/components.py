"""Connected components of a table of links, without gathering a component anywhere.

Each round every node takes the neighbour of least rank as its parent if that ranks below itself, links are rewritten to parents
and links within a parent vanish. Ranks are the ids in two rounds of three, which contracts any star, and hashes in the third, so that the expected number of nodes shrinks by a constant factor whatever the components' shapes. Groupings combine before the shuffle and joins are plain equi-joins, which Spark can split where a node
has many links. Every round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): for every node of links (a, b), the smallest node it reaches, itself included."""
    edges = scratch.table(_plain(links), "links")
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        order = (lambda c: F.lit(0).cast("long")) if len(hops) % 3 < 2 else (lambda c: F.xxhash64(F.col(c), F.lit(len(hops))))  # noqa: B023
        rank = lambda c: F.struct(order(c).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("node"), rank("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), rank("a").alias("near")))
        best = both.groupBy("node").agg(F.min("near").alias("near")).where(F.col("near") < rank("node"))
        hop = scratch.table(best.select("node", F.col("near.n").alias("parent")), "parents")
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(hop.select(F.col("node").alias(end), F.col("parent").alias(f"p{end}")), end, "left").withColumn(end, F.coalesce(f"p{end}", end)).drop(f"p{end}")
        after = scratch.table(_plain(moved), "links")
        scratch.drop(edges)
        edges = after
        scratch.settle()
        hops.append(hop)
    if not hops:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    used = list(hops)
    root = hops.pop().withColumnRenamed("parent", "root")
    for hop in reversed(hops):
        far = root.select(F.col("node").alias("parent"), "root")
        near = hop.join(far, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        root = scratch.table(near.unionByName(root).groupBy("node").agg(F.min("root").alias("root")), "roots")
    least = root.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
    members = root.unionByName(least.select(F.col("root").alias("node"), "root")).distinct()
    out = scratch.table(members.join(least, "root").select("node", "component"), "components")
    scratch.drop(edges, *used)
    return out


def _plain(links: DataFrame) -> DataFrame:
    """Each link once, its smaller end first; none from a node to itself."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
