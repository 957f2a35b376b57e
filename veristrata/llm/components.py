"""Connected components of a distributed edge list: alternating large-star and small-star rounds.

Each round is two grouped minima (pre-aggregated before the shuffle) and two joins, whose hot keys
adaptive execution may split. Rounds are written to the shared folder, so a lost executor repeats
one round's task at most. No edge, node or label goes to the driver; only a count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _links(df: DataFrame) -> DataFrame:
    """Distinct ``(child, parent)`` with child > parent."""
    return df.select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")).where("child <> parent").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionAll(e.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _links(both.join(low, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("child").agg(F.min("parent").alias("m"))
    moved = e.join(low, "child").where("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return _links(moved.unionAll(low.select("child", F.col("m").alias("parent"))))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges``: columns ``child, parent`` (long). Returns ``node, root`` for every node that is not
    itself the least node of its component. Null ends and loops are ignored."""
    now = durable(_links(edges.where("child is not null and parent is not null")), label)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("child", "parent")).alias("x")).first()
        if state == seen or not state.n:
            return now.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        seen = state
        now = durable(_small_star(_large_star(now)), label)
