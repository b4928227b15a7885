"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import drop_stored, stored

#: Rounds are a logarithm of the longest path in practice; this only bounds a run that a fault keeps from ending.
MOST_ROUNDS = 60


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Join each node's neighbours to the least one it knows. Large star: its larger neighbours (``both`` directions
    are listed); small star: the node itself and its smaller neighbours. A node's neighbours are never gathered in one
    row: the least is a partial aggregate, joined back on the node."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = e.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``: ``root`` is the least node reachable.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round's tasks.
    Loops and repeated edges are allowed; an empty table gives an empty result; null ends are dropped.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    signature = None
    for _ in range(MOST_ROUNDS):
        new = stored(_star(_star(now, both=True), both=False), "edges")
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop_stored(now)
        now = new
        if (row["n"], row["s"]) == signature:
            break
        signature = (row["n"], row["s"])
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
