"""Mixing sources to target weights by temperature.

Token shares of sources are raised to an exponent that is bisected until the
mixture meets a target entropy or keeps the largest number of repetitions within
a limit.  The normalised weights become token budgets, and every source spends
its budget in whole passes and one partial pass: blocks of its documents in a
permuted order, documents permuted in a block, until the budget is spent.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.storage import Scratch, unused

#: A source is cut in at most so many blocks; their sizes then grow with it.
MAX_BLOCKS = 1 << 16
#: Rows from which a source has a further block, however few tokens they hold.
BLOCK_ROWS = 4096
#: Halvings that one pass over the table of sources decides, and passes.
_DEPTH, _PASSES = 6, 6


def token_count(text: Column) -> Column:
    """Words between runs of ASCII white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _measures(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, ...]]:
    """For each exponent: sum of p^a, sum of p^a ln p, largest and least p^(a-1)."""
    powers = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("q", F.pow("p", "a"))
    rows = powers.groupBy("a").agg(F.sum("q"), F.sum(F.col("q") * F.log("p")), F.max(F.col("q") / F.col("p")), F.min(F.col("q") / F.col("p"))).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def bisect_exponent(
    shares: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget_ratio: float, keep_all: bool = False, highest: float = 8.0
) -> float:
    """Exponent in [0, highest] for a table of positive shares ``p``.

    With ``target_entropy`` (nats): entropy falls as the exponent grows, so the
    largest exponent whose entropy is still at least the target.  With
    ``repetition_limit``: the smallest exponent up to 1 at which no source is
    repeated more often than the limit; 1 where even that repeats too often.
    With ``keep_all`` the budget is at least that of a whole pass of every source.
    Each job measures all midpoints of the next halvings, then walks down them.
    """
    by_entropy = target_entropy is not None
    low, high = 0.0, highest if by_entropy else 1.0

    def enough(a: float, m: tuple[float, ...]) -> bool:
        z, weighted_log, top, bottom = m
        if by_entropy:
            return math.log(z) - a * weighted_log / z < target_entropy
        return max(budget_ratio, z / bottom if keep_all else 0.0) * top / z <= repetition_limit

    for _ in range(_PASSES):
        step = (high - low) / (1 << _DEPTH)
        grid = [low + step * i for i in range((1 << _DEPTH) + 1)]
        at = _measures(shares, grid)
        if not at:
            return 1.0
        i, j = 0, 1 << _DEPTH
        if enough(grid[i], at[grid[i]]):
            return grid[i]
        if not enough(grid[j], at[grid[j]]):
            return grid[j]
        while j - i > 1:
            mid = (i + j) // 2
            i, j = (i, mid) if enough(grid[mid], at[grid[mid]]) else (mid, j)
        low, high = grid[i], grid[j]
    return low if by_entropy else high


def temperature_mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    repetition_limit: float | None = 4.0,
    budget_tokens: int | None = None,
    keep_all: bool = False,
    block_tokens: int = 1 << 14,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    positions: bool = True,
) -> DataFrame:
    """The mixture: every input row once for each pass that draws it.

    Adds ``mix_epoch`` (0, 1, ...), ``mix_tokens``, ``mix_weight``,
    ``mix_exponent`` and, with ``positions``, ``mix_position`` to the columns of
    ``docs`` (columns of these names are replaced).  The budget is
    ``budget_tokens``, else as many tokens as there are.  ``keep_all`` raises the
    budget to the least at which every source makes a whole pass, so that mixing
    only repeats rows and drops none.

    ``mix_position`` counts a source's drawn rows from 0 in the order of its
    permutation: pass by pass, block by block, and permuted in each block.

    A null source is a source of its own.  A source without tokens has no share;
    its rows come out once.  Rows that share an id (or have none) are drawn
    together, so a pass may overrun its budget by one such group.  Null and empty
    texts cost nothing and go with their place in the permutation.  An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(_key(F.col(source_col)).alias("s"), order.alias("h"), token_count(F.col(text_col)).alias("t"))
    rows = scratch.table(rows, "tokens")
    totals = scratch.table(rows.groupBy("s").agg(F.sum("t").alias("n"), F.count("*").alias("c")), "sources")
    held = totals.where("n > 0")
    everything = held.agg(F.sum("n").cast("double")).first()[0] or 1.0
    shares = held.withColumn("p", F.col("n") / F.lit(everything))
    ratio = (budget_tokens or everything) / everything
    exponent = bisect_exponent(shares, target_entropy, repetition_limit, ratio, keep_all)
    norm = shares.agg(F.sum(F.pow("p", F.lit(exponent))), F.min(F.pow("p", F.lit(exponent - 1.0)))).first()
    if keep_all and norm[0]:
        ratio = max(ratio, norm[0] / norm[1])
    weight = F.pow("p", F.lit(exponent)) / F.lit(norm[0] or 1.0)
    spend = F.floor(weight * F.lit(everything * ratio) + F.lit(1e-6)).cast("long")
    plan = shares.withColumn("w", weight).withColumn("budget", spend)
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("n")).cast("int")).withColumn("rest", F.col("budget") % F.col("n"))
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.greatest(F.col("n") / F.lit(block_tokens), F.col("c") / F.lit(BLOCK_ROWS)))).alias("blocks")
    plan = scratch.table(totals.select("s", "c", blocks).join(plan.select("s", "w", "passes", "rest"), "s", "left"), "plan")
    # The partial pass ends in one block of each source: find it from block totals,
    # then the last document drawn in it.  Both are hashes, so that drawing is a filter.
    block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.col("blocks"))
    placed = rows.join(plan.select("s", "blocks"), "s").withColumn("b", F.xxhash64(F.lit(seed + 2), F.col("s"), block))
    sums = placed.groupBy("s", "b").agg(F.sum("t").alias("t"), F.count("*").alias("c"))
    run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = scratch.table(sums.withColumn("upto", F.sum("t").over(run)).withColumn("before", F.sum("c").over(run) - F.col("c")), "blocks")
    last = sums.join(plan.where("rest > 0").select("s", "rest"), "s").where("upto >= rest and upto - t < rest and t > 0")
    last = scratch.table(last.select("s", F.col("b").alias("end_b"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left")), "ends")
    inside = placed.join(last, "s").where("b = end_b").groupBy("s", "h").agg(F.sum("t").alias("t"), F.first("left").alias("left"))
    inside = inside.withColumn("upto", F.sum("t").over(Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = last.join(inside.where("upto >= left and upto - t < left").select("s", F.col("h").alias("end_h")), "s").select("s", "end_b", "end_h")
    plan = scratch.table(plan.join(ends, "s", "left").withColumn("held", F.col("rest").isNotNull()).drop("rest"), "draw")

    made = ["mix_epoch", "mix_tokens", "mix_weight", "mix_exponent", "mix_position"]
    kept = [c for c in docs.columns if c not in made]
    # Working columns take names that the input does not have.
    own = dict(zip([*plan.columns, "h", "b", "before", "rank"], unused(docs, *["_" + c for c in plan.columns], "_h", "_b", "_before", "_rank"), strict=True))
    col = {k: F.col(v) for k, v in own.items()}
    drawn = docs.select(*kept, _key(F.col(source_col)).alias(own["s"]), order.alias(own["h"]), token_count(F.col(text_col)).alias("mix_tokens"))
    drawn = drawn.join(plan.select([F.col(c).alias(own[c]) for c in plan.columns]), own["s"])
    block = F.pmod(F.xxhash64(F.lit(seed + 1), col["h"]), col["blocks"])
    drawn = drawn.withColumn(own["b"], F.xxhash64(F.lit(seed + 2), col["s"], block))
    position = []
    if positions:
        inside = Window.partitionBy(own["s"], own["b"]).orderBy(own["h"], "mix_tokens")
        starts = sums.select(F.col("s").alias(own["s"]), F.col("b").alias(own["b"]), F.col("before").alias(own["before"]))
        drawn = drawn.withColumn(own["rank"], F.row_number().over(inside)).join(starts, [own["s"], own["b"]])
        position = [(F.col("mix_epoch") * col["c"] + col["before"] + col["rank"] - 1).cast("long").alias("mix_position")]
    partial = (col["b"] < col["end_b"]) | ((col["b"] == col["end_b"]) & (col["h"] <= col["end_h"]))
    passes = F.when(~col["held"], 1).otherwise(col["passes"] + F.coalesce(partial, F.lit(False)).cast("int"))
    drawn = drawn.withColumn(own["passes"], passes).where(col["passes"] > 0)
    drawn = drawn.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), col["passes"] - 1)))
    return drawn.select(*kept, "mix_epoch", "mix_tokens", F.coalesce(col["w"], F.lit(0.0)).alias("mix_weight"), F.lit(exponent).alias("mix_exponent"), *position)
