"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketflow.llm.common import discard, materialize, salted_join


#: Edges (16 bytes each) above which stars are joined in salted parts.
SALT_FROM = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label (node, label) of every node that occurs in ``edges``; label is the smallest node of its component.

    Large-star and small-star rounds: each node links its larger, then its smaller
    neighbours to the smallest neighbour it knows, until only stars are left, after a
    number of rounds logarithmic in the size of the largest component.  The edge count
    never grows and the minimum per node is aggregated before the shuffle.  Where there
    are more than ``SALT_FROM`` edges, the centre of a star is joined in salted parts, so no
    task gets all its edges; of fewer edges no star is too large for a task.  Each round is
    written to the shared folder, so lineage stays one round deep; the round before it is
    then deleted.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
        seen = tuple(state)
        salts = 16 if state["n"] > SALT_FROM else 1
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, "a", "b", salts=salts).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = salted_join(large, least, "a", "b", salts=salts)
        small = met.select("a", F.col("m").alias("b")).union(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        last, now = now, materialize(small.distinct())
        discard(last)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
