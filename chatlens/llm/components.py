"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every end of ``edges(a long, b long)``.

    ``comp`` is the smallest node that can be reached.  Each round joins edges
    with per-node minima (partially aggregated before the shuffle) and writes
    the contracted edges to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.  The driver learns only whether to go on.
    """
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        told = both.join(least, "a")
        if larger:
            return told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        moved = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b")

    def contracted(pairs: DataFrame) -> bool:
        """Every node hangs on one root, and roots hang on nothing."""
        roles = pairs.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            pairs.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not contracted(now):
        now = stored(star(star(now, True).distinct(), False).distinct(), "edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        roots.select("node", F.col("node").alias("comp")))
