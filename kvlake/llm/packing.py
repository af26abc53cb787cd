"""Packing by optimal length buckets.

A histogram of all sequence lengths feeds a dynamic program that chooses the
bucket boundaries with the least padding; inside each bucket, batches are formed
whose padded size stays within a token budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.mixing import token_count
from kvlake.llm.storage import Scratch

#: Rows of a bucket that one shard numbers.
SHARD_ROWS = 1 << 16


def optimal_boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    Padding of a bucket is its count times its longest length less its tokens.
    Layer by layer, the best cut before length j is a minimum over lines whose
    slopes fall with the count so far, so one sweep with a lower hull serves all
    lengths: O(buckets x lengths).  Ties take fewer buckets.
    """
    lengths = [n for n, _ in sorted(histogram)]
    counts, tokens = [0], [0]
    for n, c in sorted(histogram):
        counts.append(counts[-1] + c)
        tokens.append(tokens[-1] + n * c)
    m = len(lengths)
    if not m:
        return []
    cost = [0] + [lengths[j] * counts[j + 1] - tokens[j + 1] for j in range(m)]
    cuts: list[list[int]] = [[0] * (m + 1)]
    best, best_layer = cost[m], 0
    for layer in range(1, min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, index of the cut
        now, cut, at = [0] * (m + 1), [0] * (m + 1), 0
        for j in range(1, m + 1):
            slope, intercept = -counts[j - 1], cost[j - 1] + tokens[j - 1]
            while len(hull) > 1 and (intercept - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, intercept, j - 1))
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * x + hull[at][1] + x * counts[j] - tokens[j]
            cut[j] = hull[at][2]
        cost = now
        cuts.append(cut)
        if cost[m] < best:
            best, best_layer = cost[m], layer
    ends, j = [], m
    for layer in range(best_layer, -1, -1):
        ends.append(lengths[j - 1])
        j = cuts[layer][j]
        if not j:
            break
    return ends[::-1]


def pack_buckets(
    docs: DataFrame,
    buckets: int = 16,
    batch_tokens: int = 65536,
    max_length: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 23,
) -> DataFrame:
    """One row per sequence: id, piece, start, tokens, bucket, bucket_length, batch, padding.

    A text of over ``max_length`` words makes several sequences, none longer than
    that; together they cover all its words (``start`` is the first word's
    number).  So there are at most ``max_length + 1`` distinct lengths, which
    bounds the histogram that goes to the driver.  Batches are numbered in each
    bucket; a batch's padded size is at most ``batch_tokens`` unless one sequence
    alone is longer.  Only a bucket's last batch may be short.

    Null and empty texts make one sequence of no words.  Repeated rows are packed
    as often as they occur, ids may be null, other columns are ignored, and an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    counted = docs.select(F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.lit(max_length)).cast("int") - 1)
    pieces = counted.select("id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * F.lit(max_length)
    pieces = scratch.table(pieces.select("id", "piece", start.alias("start"), F.least(F.lit(max_length), F.col("n") - start).alias("tokens")), "pieces")
    histogram = pieces.groupBy("tokens").agg(F.count("*").alias("rows")).collect()
    ends = optimal_boundaries([tuple(r) for r in histogram], buckets) or [0]
    counts = [sum(r["rows"] for r in histogram if (ends[i - 1] if i else -1) < r["tokens"] <= e) for i, e in enumerate(ends)]
    per_batch = [max(1, batch_tokens // max(1, e)) for e in ends]
    shards = [max(1, -(-c // SHARD_ROWS)) for c in counts]

    def by_bucket(values: list[int]):
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)

    bucket = sum((F.col("tokens") > F.lit(e)).cast("int") for e in ends[:-1]) if len(ends) > 1 else F.lit(0)
    mixed = F.xxhash64(F.lit(seed), F.col("id"), F.col("piece"), F.col("tokens"))
    dealt = pieces.withColumn("bucket", bucket).withColumn("h", mixed)
    # Hash ranges, so that shards follow each other in the order of the hash.
    dealt = dealt.withColumn("shard", F.floor((F.shiftrightunsigned("h", 33)) * by_bucket(shards) / F.lit(float(1 << 31))).cast("long"))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    offsets = scratch.table(offsets, "offsets")
    inside = Window.partitionBy("bucket", "shard").orderBy("h", "id", "piece", "tokens")
    numbered = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["bucket", "shard"])
    place = F.col("offset") + F.col("rank") - 1
    return numbered.select(
        F.col("id").alias(id_col), "piece", "start", "tokens", "bucket", by_bucket(ends).alias("bucket_length"),
        F.floor(place / by_bucket(per_batch)).cast("long").alias("batch"), (by_bucket(ends) - F.col("tokens")).alias("padding"),
    )
