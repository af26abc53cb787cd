"""SimHash near-duplicates found with Burkhard-Keller trees.

A fingerprint is the bitwise majority over the XXH64 values of a text's word
shingles.  Links are pairs of fingerprints within a Hamming radius.  Distinct
fingerprints are dealt to shards such that every linked pair meets in one shard
at least; each shard builds a BK-tree (children keyed by their integer distance
to the parent) and a lookup follows only edges within the radius.

Shards travel by shuffle, not by broadcast: all trees together grow with the
corpus, so no size bound for a broadcast of them can be proven.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.exactdedup import flagged, key_filter
from kvlake.llm.graph import connected_components
from kvlake.llm.storage import Scratch, prepare_workers, unused

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASK = (1 << 64) - 1


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included.

    A-Z is lower-cased and words are split at ASCII white space.  Fewer words
    than a shingle make one shingle of all of them; no word, none.
    """
    parts = (text or "").encode("utf-8").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def _spread(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` independent 64-bit values of each hash; the first is the hash."""
    if lanes == 1:
        return hashes.reshape(-1, 1)
    step = np.arange(1, lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = hashes[:, None] + step[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([hashes[:, None], x ^ (x >> np.uint64(31))], axis=1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Majority of each bit over the hashes, as ``lanes`` 64-bit words; none: zero."""
    total = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        part = np.ascontiguousarray(_spread(hashes[at : at + 255], lanes), dtype="<u8").view(np.uint8).reshape(-1, 8 * lanes)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


class BKTree:
    """Integers under Hamming distance; each node's children by distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, value: int, radius: int) -> list:
        """What was added with values within the radius; other edges are not followed."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            held, item, below = stack.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                found.append(item)
            if below:
                stack += [child for k, child in below.items() if d - radius <= k <= d + radius]
        return found

    def add(self, value: int, item: object) -> None:
        leaf: list = [value, item, {}]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while (nxt := node[2].get(d := (node[0] ^ value).bit_count())) is not None:
            node = nxt
        node[2][d] = leaf


class _Groups:
    """Disjoint groups of items."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[b] = a
        return a != b


def bk_links(values: Iterable[int], radius: int) -> list[tuple[int, int]]:
    """Links that span the groups of a shard: one less than each group's members.

    Each value is looked up in the tree of the earlier ones and then added.  A
    link inside a group that is joined already is left out: it changes no group,
    and a dense group would make the square of its size of them.
    """
    tree, groups, links = BKTree(), _Groups(), []
    for value in dict.fromkeys(values):
        links += [(held, value) for held in tree.near(value, radius) if groups.join(held, value)]
        tree.add(value, value)
    return links


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` for every row; a null or blank text has fingerprint zero."""
    prepare_workers(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(x.as_py(), words))[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, "<u8").view("<i8"))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scan, f"id {source.schema['id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shard_masks(width: int, base: int, radius: int) -> list[int]:
    """Bit masks such that values within ``radius`` agree under one of them at least.

    ``width`` bits from ``base`` are cut in ``radius + 2`` bands; at most
    ``radius`` bands can differ, so two agree.
    """
    bands = radius + 2
    cuts = [base + width * i // bands for i in range(bands + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(bands)]
    return [a | b for a, b in combinations(masks, 2)]


def _keys(value: Column, masks: list[int], first: int) -> Column:
    return F.array(*[F.struct(F.lit(first + i).alias("part"), value.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])


def hamming_links(prints: DataFrame, radius: int, scratch: Scratch, crowded: int = 2048) -> DataFrame:
    """Links ``(u, v)`` that span all groups of distinct fingerprints ``fp``.

    Every pair within the radius shares a shard ``(part, key)``.  Shards of over
    ``crowded`` fingerprints are dealt again by bands of the bits that the first
    key leaves open, so that no shard can outgrow the values of the bits that
    both keys leave open (65,536 at radius 2); nothing is dropped.
    """
    masks = _shard_masks(64, 0, radius)
    dealt = scratch.table(prints.select("fp", F.explode(_keys(F.col("fp"), masks, 0)).alias("k")).select("fp", "k.part", "k.key"), "dealt")
    sizes = scratch.table(dealt.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    dealt = dealt.join(sizes, ["part", "key"])
    calm = dealt.where(F.col("n") <= crowded).select("part", "key", "fp")
    again = None
    for i, m in enumerate(masks):
        free = [b for b in range(64) if not m >> b & 1]
        n = radius + 2
        bands = [sum(1 << b for b in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
        narrow = [m | a | b for a, b in combinations(bands, 2)]
        keys = _keys(F.col("fp"), narrow, len(masks) * (i + 1))
        again = F.when(F.col("part") == i, keys) if again is None else again.when(F.col("part") == i, keys)
    tight = dealt.where(F.col("n") > crowded).select("fp", F.explode(again).alias("k")).select("k.part", "k.key", "fp")
    shards = calm.unionByName(tight).groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link for fps in batch.column(0) for link in bk_links((x & _MASK for x in fps.as_py()), radius)]
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    return shards.mapInArrow(search, "u bigint, v bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    id that links lead to, the row's own included.  Null and blank texts have
    fingerprint zero and link like any other.  Rows with a null id take part and
    keep it, but never name a component unless nothing else can (then null).
    Repeated rows come out as often as they go in; other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, id_col, text_col, words), "prints")
    lowest = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("low")), "lowest")
    links = hamming_links(lowest.select("fp"), radius, scratch)
    roots = connected_components(links, scratch)
    grouped = lowest.join(roots, lowest["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = scratch.table(grouped.join(best, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Bits of a long fingerprint that are compared where two texts meet, and the
#: radius: at similarity 0.8 a bit differs with chance 0.15, so 0.999 of such pairs
#: differ in at most 57 of 256 bits.
SKETCH_BYTES, SKETCH_RADIUS = 32, 57
_AGREE, _RECALL = 0.85, 0.99
#: Texts that share a band of their bits by chance, on average, and least bits of a band.
_MET_BY_CHANCE, _LEAST_WIDTH = 4, 16
#: Texts in a bucket from which they are linked without being compared.
CROWDED = 4096
_KEY_BYTES = 16


def band_shape(texts: int) -> tuple[int, int]:
    """Bits of a band, and how many bands, for so many texts.

    A band grows by a bit with each doubling of the texts, so the texts that meet
    by chance stay as few; the number of bands follows, so that 0.99 of the pairs
    of similarity 0.8 agree in one band at least.
    """
    width = max(_LEAST_WIDTH, math.ceil(math.log2(max(1, texts) / _MET_BY_CHANCE)))
    return width, math.ceil(math.log(1 - _RECALL) / math.log(1 - _AGREE**width) / 8) * 8


def _text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, _KEY_BYTES)


def long_sketches(docs: DataFrame, id_col: str, text_col: str, words: int, shape: tuple[int, int]) -> DataFrame:
    """``(key, id, sketch, bands)`` of every row; ``key`` names the text.

    A shingle counts once however often the text repeats it, as in the sets that
    decide on a link.
    """
    prepare_workers(docs.sparkSession)
    source = docs.select(_text_key(F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    width, bands = shape
    lanes = -(-width * bands // 64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, power = np.arange(bands, dtype=np.int64) << width, 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            prints = [fingerprint(np.unique(shingle_hashes(x.as_py(), words)), lanes) for x in batch.column(2)]
            bits = [np.unpackbits(f.view(np.uint8), bitorder="little")[: width * bands].reshape(bands, width) for f in prints]
            buckets = pa.array([first + b @ power for b in bits], pa.list_(pa.int64()))
            sketch = pa.array([f.tobytes()[:SKETCH_BYTES] for f in prints], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sketch, buckets], ["key", "id", "sketch", "bands"])

    return source.mapInArrow(scan, f"key binary, id {source.schema['id'].dataType.simpleString()}, sketch binary, bands array<bigint>")


def _near_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the groups of each bucket, from rows sorted by bucket and item.

    Items come in the order of their keys, and a link goes to the smallest key in
    reach, so the buckets in which a group meets give the same few links.  Chance
    brings a few texts to a bucket; from ``CROWDED`` on most are near copies, so
    all are linked to the first without being compared or held.  Links only make
    crowds: which texts are similar is decided there.
    """
    bucket, items, first = None, [], None

    def ended() -> list[tuple]:
        tree, groups, links = BKTree(), _Groups(), []
        for item in items if len(items) > 1 else []:
            key, value = item[:_KEY_BYTES], int.from_bytes(item[_KEY_BYTES:], "little")
            links += [(other, key) for other in sorted(tree.near(value, SKETCH_RADIUS)) if groups.join(other, key)]
            tree.add(value, key)
        return links

    rows: list[tuple] = []
    for batch in batches:
        buckets = batch.column(0).to_numpy()
        if not len(buckets):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if buckets[a] != bucket:
                rows += ended()
                bucket, items, first = buckets[a], [], None
            part = batch.column(1).slice(a, b - a).to_pylist()
            if first is None and len(items) + len(part) < CROWDED:
                items += part
            else:
                part = items + part
                first, items = first or part[0][:_KEY_BYTES], []
                rows += [(first, item[:_KEY_BYTES]) for item in part if item[:_KEY_BYTES] != first]
            if len(rows) > 4096:
                yield _binary_batch(rows)
                rows = []
    yield _binary_batch(rows + ended())


def _binary_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], ["u", "v"])


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """How often a hash falls on each of ``bits`` places, modulo 2.

    Two of these differ in no more bits than the sets of hashes have unequal
    members, so they bound an intersection from above and never rule out a link.
    """
    counts = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def jaccard_links(sets: list[np.ndarray], first: int, similarity: float, groups: list | None = None) -> list[tuple[int, int]]:
    """Links that span the groups of sorted sets of hashes, by their Jaccard similarity.

    With ``first``, only pairs of one of the first sets and one of the others
    count; with 0, all pairs.  ``groups`` names the groups that sets are in
    already.  A pair is compared if it can still join groups and neither the sizes
    nor the parities rule it out, the most alike ones first.
    """
    n, links = len(sets), []
    sizes = np.array([len(x) for x in sets], np.float64)
    bits = 1 << int(min(16, max(10, np.ceil(np.log2(4 * sizes.mean() + 1)))))
    parities = np.stack([_parity(x, bits) for x in sets])
    label = np.arange(n)
    if groups is not None:
        place = {g: i for i, g in enumerate(dict.fromkeys(groups))}
        label = np.array([place[g] for g in groups])
    for x in range(max(first, 1), n):
        upto = first or x
        fits = np.minimum(sizes[:upto], sizes[x]) >= similarity * np.maximum(sizes[:upto], sizes[x])
        near = np.flatnonzero(fits & (label[:upto] != label[x]))
        if not len(near):
            continue
        unequal = np.bitwise_count(parities[near] ^ parities[x]).sum(axis=1, dtype=np.int64)
        most = (sizes[near] + sizes[x] - unequal) / 2
        able = most >= similarity * (sizes[near] + sizes[x] - most)
        for y in near[able][np.argsort(unequal[able], kind="stable")].tolist():
            if label[y] == label[x]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                links.append((y, x))
                label[label == label[y]] = label[x]
    return links


def _compared(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(u, v)`` that span the groups of texts in each meeting.

    ``rows`` has ``(crowd, a, b, side, key, root, text)``: texts of side 0 and 1
    of a meeting ``(crowd, a, b)`` are compared with each other, or all texts where
    there is no side 1.  Texts of one ``root`` are linked already.
    """
    prepare_workers(rows.sparkSession)
    dealt = rows.select("crowd", "a", "b", "side", "key", "root", "text").repartition("crowd", "a", "b").sortWithinPartitions("crowd", "a", "b", "side", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, roots, sets, sides = None, [], [], [], []

        def ended() -> pa.RecordBatch:
            first = sides.count(0) if sides[-1] else 0
            lone = bool(sides[-1]) and not first or len(set(roots)) < 2
            found = [] if lone else jaccard_links(sets, first, similarity, roots)
            return _binary_batch([(keys[a], keys[b]) for a, b in found])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                *meeting, side, key, root, text = [x.as_py() for x in row]
                if meeting != now:
                    if now:
                        yield ended()
                    now, keys, roots, sets, sides = meeting, [], [], [], []
                keys.append(key)
                roots.append(root)
                sets.append(np.unique(shingle_hashes(text, words)))
                sides.append(side)
        if now:
            yield ended()

    return dealt.mapInArrow(compare, "u binary, v binary")


#: Texts of a block's largest group that stand for it, and blocks that meet at a time.
_STAND_FOR, _NEIGHBOURS = 16, 64


def _with_roots(texts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``texts`` with the ``root`` that links lead each key to."""
    roots = connected_components(links, scratch).select(F.col("node").alias("key"), "root")
    return texts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def similar_links(crowds: DataFrame, words: int, similarity: float, block_bytes: int) -> DataFrame:
    """Links ``(u, v)`` that span the groups of similar texts in each crowd.

    ``crowds`` has ``(crowd, key, text)``.  A crowd of over ``block_bytes`` is cut
    in blocks by key, and no link is lost on its way:

    1. All texts of a block are compared.  A crowd of one block is done.
    2. Some texts of each block's largest group meet those of the next blocks, which
       joins the groups of near copies that blocks have cut.
    3. A link that is not known by then has an end outside the crowd's largest
       group.  The texts outside, in blocks of their own, meet all blocks.

    So a crowd that is one group of near copies moves each text a few times, and
    only texts outside the largest group cost as many meetings as there are blocks.
    """
    scratch = Scratch(crowds.sparkSession, "similar")
    sizes = crowds.groupBy("crowd").agg(F.sum(F.octet_length("text")).alias("total"), F.count("*").alias("texts")).where(F.col("total") > block_bytes)
    large = scratch.table(sizes.select("crowd", F.least("texts", F.ceil(F.col("total") / block_bytes)).cast("int").alias("n")).where("n > 1"), "large")
    cut = crowds.join(large, "crowd", "left").withColumn("b", F.pmod(F.xxhash64("key"), F.coalesce("n", F.lit(1))).cast("int"))
    zero = F.lit(0)
    whole = cut.select("crowd", zero.alias("a"), "b", zero.alias("side"), "key", F.col("key").alias("root"), "text")
    found = scratch.table(_compared(whole, words, similarity), "inside")
    if large.isEmpty():
        return found
    parts = cut.where("n is not null").select("crowd", "n", "b", "key", "text")
    inside = found.join(parts.select(F.col("key").alias("v")), "v", "left_semi")

    rooted = scratch.table(_with_roots(parts.select("crowd", "n", "b", "key"), inside.select("u", "v"), scratch), "rooted")
    counts = rooted.groupBy("crowd", "b", "root").agg(F.count("*").alias("c"))
    mains = counts.groupBy("crowd", "b").agg(F.max_by("root", F.struct("c", "root")).alias("root"))
    order = Window.partitionBy("crowd", "b").orderBy(F.xxhash64("key"), "key")
    stand = rooted.join(mains, ["crowd", "b", "root"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _STAND_FOR)
    # Neighbouring meetings share a block, so that groups reach from the first block to the last.
    step = _NEIGHBOURS - 1
    meets = F.array_distinct(F.array(F.floor(F.col("b") / step), F.floor(F.greatest(F.col("b") - 1, zero) / step))).cast("array<int>")
    stand = stand.select("crowd", zero.alias("a"), F.explode(meets).alias("b"), zero.alias("side"), "key", "root")
    between = scratch.table(_compared(stand.join(parts.select("key", "text"), "key"), words, similarity), "between")

    joined = inside.select("u", "v").unionByName(between)
    rooted = scratch.table(_with_roots(parts.select("crowd", "n", "b", "key"), joined, Scratch(crowds.sparkSession, "similar")), "joined")
    counts = rooted.groupBy("crowd", "root").agg(F.count("*").alias("c"))
    mains = counts.groupBy("crowd").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    placed = scratch.table(rooted.join(mains, "crowd").withColumn("outside", F.col("root") != F.col("main")).drop("main").join(parts.select("key", "text"), "key"), "placed")
    spread = placed.where("outside").groupBy("crowd").agg(F.least(F.count("*"), F.ceil(F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("m"))
    placed = placed.join(scratch.table(spread, "spread"), "crowd")
    own = F.pmod(F.xxhash64(F.lit(1), "key"), F.col("m")).cast("int")
    outer = placed.where("outside").select("crowd", own.alias("a"), F.explode(F.sequence(zero, F.col("n") - 1)).alias("b"), zero.alias("side"), "key", "root", "text")
    all_ = placed.select("crowd", F.explode(F.sequence(zero, F.col("m") - 1)).alias("a"), "b", F.lit(1).alias("side"), "key", "root", "text")
    across = scratch.table(_compared(outer.unionByName(all_), words, similarity), "across")
    return found.unionByName(between).unionByName(across)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block_bytes: int = 4 << 20
) -> DataFrame:
    """``(key, keep_key, keep_id)`` of every text that is not the one of its group that stays.

    Texts are linked where their sets of word shingles have at least the Jaccard
    ``similarity``; groups are what links reach, and the text with the smallest
    id stays (a null id is larger than any; then the smaller key).  Candidates
    come from SimHash fingerprints of 1,024 bits and more: texts meet where a band
    of 16 bits and more agrees, and BK-trees link those that differ in few bits to
    crowds.  Inside a crowd texts are compared by their shingles, so no group
    holds a false link; about one link of similarity 0.8 in a hundred is not
    found, fewer above.  Texts without words are one group, null ones included.
    Rows that share a text count as one, other columns are ignored, and an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = long_sketches(docs, id_col, text_col, words, band_shape(docs.count()))
    sketches = scratch.table(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "sketches")
    dealt = sketches.select(F.explode("bands").alias("bucket"), F.concat("key", "sketch").alias("item"))
    met = dealt.repartition("bucket").sortWithinPartitions("bucket", "item").mapInArrow(_near_links, "u binary, v binary")
    crowds = connected_components(scratch.table(met.distinct(), "met"), scratch).select(F.col("node").alias("key"), F.col("root").alias("crowd"))
    crowds = crowds.unionByName(crowds.select(F.col("crowd").alias("key"), "crowd").distinct())
    bodies = docs.select(_text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["key"])
    members = scratch.table(bodies.join(crowds, "key").select("crowd", "key", "text"), "members")
    found = scratch.table(similar_links(members, words, similarity, block_bytes), "links")
    roots = connected_components(found, Scratch(docs.sparkSession, "neardup"))
    named = sketches.select("key", "id").join(roots, sketches["key"] == roots["node"], "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    kept = named.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").select("root", "first")
    out = named.join(kept, "root").where("key <> first.key")
    return scratch.table(out.select("key", F.col("first.key").alias("keep_key"), F.col("first.id").alias("keep_id")), "dropped")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text stays in its group; see ``near_duplicates``.

    Rows that share one text all stay or go: exact copies are another operator's.
    All columns stay as they are, whatever their names.  Only rows that a filter
    of the dropped texts may hold are joined with these; the others do not move.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    dropped = near_duplicates(docs, id_col, text_col, words, similarity).select("key")
    key, flag = unused(docs, "key", "flag")
    marked = flagged(docs.withColumn(key, _text_key(F.col(text_col))), key, key_filter(dropped, "key", scratch), flag)
    kept = marked.where(F.col(flag)).join(dropped.withColumnRenamed("key", key), key, "left_anti")
    return marked.where(~F.col(flag)).unionByName(kept).select(docs.columns)
