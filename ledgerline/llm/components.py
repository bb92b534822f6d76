"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and then a small-star round over edges (u, v) with v < u; both keep what is connected connected."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Read back, so that the join has a plain shuffle on both sides: Spark can then split the edges of a large star's centre.
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v) that is not the smallest of its component; component is the smallest.

    Each round is staged; the rounds end when one leaves the table as it was. Only two numbers reach the driver a round.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == state or not row["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (row["n"], row["x"])
        now = staged(_stars(now))
    raise RuntimeError("the components did not settle")
