"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.storage import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Large-star / small-star rounds over ``links(u, v)`` until nothing changes.

    Returns ``(node, root)`` for every node with a link, except the roots
    themselves; the root is the smallest node of the component.  Rounds grow with
    the logarithm of the longest chain.  Self-links and repeats are ignored; an
    empty table gives an empty result.

    Smallest neighbours are written before they are joined, so that the join
    deals both sides itself and a hub's rows can be split among tasks.
    """
    edges = scratch.table(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0"
    )
    before, turn = _state(edges), 0
    while before[0]:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"around{turn}")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"large{turn}")
        lowest = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"below{turn}")
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = scratch.table(small, f"edges{turn}")
        after = _state(edges)
        for name in (f"around{turn}", f"large{turn}", f"below{turn}", f"edges{turn - 1}"):
            scratch.remove(name)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
