"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import release, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b).

    Min-label contraction.  Each round every node points at the smallest node
    of its neighbourhood, pointers are followed twice more, and links are
    rewritten between the new labels; links inside a label vanish.  A hub's
    links are only pre-aggregated by min(), never gathered.  Rounds are
    written to the shared folder.  Nodes without a link don't appear.
    """
    links = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        if low.isEmpty():
            release(low)
            break
        for _ in range(2):
            onward = low.select(F.col("id").alias("to"), F.col("to").alias("far"))
            nearer = staged(low.join(onward, "to", "left").select("id", F.coalesce("far", "to").alias("to")))
            release(low)
            low = nearer
        maps.append(low)
        ends = [low.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        moved = links.join(ends[0], "a").join(ends[1], "b")
        rest = staged(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a <> b").distinct())
        release(links)
        links = rest
    release(links)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    out = maps[0].select("id", F.col("to").alias("component"))
    for m in maps[1:]:
        onward = m.select(F.col("id").alias("component"), F.col("to").alias("far"))
        out = out.join(onward, "component", "left").select("id", F.coalesce("far", "component").alias("component"))
    return out
