"""Language identification by the nearest of several centroids per language.

Texts are TF-IDF vectors of hashed byte n-grams with length one.  Every language
has a few centroids, found by spherical k-means, and a text takes the language of
the centroid with the largest cosine.  Below a least cosine, which each language
takes from learning rows that its centroids did not see, the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.ngrams import has_letter, hashed, plain
from kvlake.llm.storage import Scratch, prepare_workers

BITS = 12
_ORDERS = (1, 2, 3)
#: The answer for a text without letters.
UNDETERMINED = "und"


def counts(text: str | None) -> np.ndarray:
    """Damped n-gram counts of the whole text."""
    data = np.frombuffer(plain(text), np.uint8)
    total = np.zeros(len(_ORDERS) << BITS, np.float32)
    for i, order in enumerate(_ORDERS):
        total[i << BITS : (i + 1) << BITS] = np.bincount(hashed(data, order, BITS), minlength=1 << BITS)
    return np.sqrt(total)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and the cosine, of each row of counts."""
        cosine = _unit(rows * self.idf) @ self.vectors.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(rows)), best], 0.0, 1.0)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from those before."""
    picked, nearest = [rows.mean(axis=0)], np.full(len(rows), -1.0)
    for _ in range(min(k, len(rows)) - 1):
        nearest = np.maximum(nearest, rows @ picked[-1])
        order = np.argsort(nearest, kind="stable")
        picked.append(rows[order[len(order) // 10]])  # far, but no outlier
    centres = _unit(np.array(picked))
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = _unit(np.array([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit(languages: Sequence[str], counted: np.ndarray, clusters: int) -> Centroids:
    """Centroids from the language and the damped counts of each learning row."""
    names = sorted(set(languages))
    seen = (counted > 0).sum(axis=0)
    idf = np.log((1 + len(counted)) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    rows = _unit(counted * idf)
    vectors, owner = [], []
    for i, lang in enumerate(names):
        found = cluster(rows[[j for j, own in enumerate(languages) if own == lang]], clusters)
        vectors.append(found)
        owner += [i] * len(found)
    return Centroids(names, idf, np.concatenate(vectors).astype(np.float32), np.array(owner))


def calibrate(languages: Sequence[str], counted: np.ndarray, clusters: int, share: float) -> dict[str, float]:
    """Least cosine of each language: what ``share`` of its unseen rows fall below.

    Every fifth row is kept from a fit of the others, and its cosine to the
    language's own centroids counts; a language without such a row rejects none.
    """
    unseen = np.arange(len(languages)) % 5 == 4
    if not unseen.any():
        return {}
    model = fit([own for own, out in zip(languages, unseen, strict=True) if not out], counted[~unseen], clusters)
    cosine = _unit(counted[unseen] * model.idf) @ model.vectors.T
    least, owners = {}, np.array(languages)[unseen]
    for i, lang in enumerate(model.languages):
        own = owners == lang
        if own.any():
            least[lang] = float(np.quantile(cosine[own][:, model.owner == i].max(axis=1), share))
    return least


def bounded_sample(rows: DataFrame, by: str, per_value: int, scratch: Scratch) -> DataFrame:
    """``(id, value)`` of the rows with the smallest hashes for each value of ``by``.

    Values are counted first, and only rows whose hash lies in the share of all
    hashes that should hold one and a half times the rows wanted are ranked, so
    a value that most rows have sends no more than a rare one; where such a share
    held too few, all rows are ranked.  Rows without an id take no part.
    """
    hashed = rows.where(F.col("id").isNotNull()).select("id", by, F.xxhash64(F.lit(5), "id").alias("h"))
    share = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    counts = scratch.table(hashed.groupBy(by).agg(F.count("*").alias("n")), "counts")
    wanted = counts.withColumn("upto", F.lit(1.5 * per_value + 50) / F.col("n"))
    low = hashed.join(wanted, by).where(share <= F.col("upto"))
    order = Window.partitionBy(by).orderBy("h", "id")
    picked = scratch.table(low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_value).select("id", by, "rank"), "sample")
    got = picked.groupBy(by).agg(F.max("rank").alias("got"))
    short = counts.join(got, by, "left").where(F.coalesce("got", F.lit(0)) < F.least("n", F.lit(per_value)))
    if short.isEmpty():
        return picked.select("id", by)
    ranked = hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_value)
    return scratch.table(ranked.select("id", by), "whole")


def _counted(rows: DataFrame) -> DataFrame:
    """``(id, lang, at, n)``: the places and counts of a text's n-grams, at most 12,288, instead of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x.as_py()) for x in batch.column(2)]
            at = [np.flatnonzero(x).astype(np.int32) for x in found]
            held = pa.array([x[i] for x, i in zip(found, at, strict=True)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), held], ["id", "lang", "at", "n"])

    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    return lettered.select("id", "lang", "text").mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, lang string, at array<int>, n array<float>")


def identify_languages(
    docs: DataFrame,
    learn: Column,
    per_language: int = 300,
    clusters: int = 3,
    reject_share: float = 0.01,
    max_samples: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: id, lang_pred, score, rejected.

    Learns from at most ``per_language`` rows of each language, and fewer where
    all languages together would pass ``max_samples`` (those with the smallest
    hash of their id; of languages beyond ``max_samples`` the most frequent),
    among rows where ``learn`` holds and id, text and language are not null; an
    id that repeats counts with the row of the smallest text.  Every row is then
    classified by its whole text alone.  A text that is null or has no letter is
    ``und`` with score 0 and rejected.  ``rejected`` marks texts whose cosine is
    below that which ``reject_share`` of the language's unseen learning rows fall
    below; ``lang_pred`` still names the nearest language.  Where nothing can be
    learned, all rows are ``und``.  Repeated rows each get an answer, other
    columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    scratch = Scratch(spark, "langid")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    usable = rows.where("learn and id is not null and text is not null and lang is not null")
    common = scratch.table(usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_samples).select("lang"), "languages")
    each = max(1, min(per_language, max_samples // max(1, common.count())))
    picked = bounded_sample(usable.join(common, "lang", "left_semi").select("id", "lang"), "lang", each, scratch).distinct()
    chosen = usable.join(F.broadcast(picked), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    samples = sorted(((r[0], r[1], r[2], r[3]) for r in _counted(chosen).collect()), key=lambda r: (r[1], r[0]))
    known = None
    if samples:
        counted = np.zeros((len(samples), len(_ORDERS) << BITS), np.float32)
        for row, (_, _, at, n) in zip(counted, samples, strict=True):
            row[at] = n
        names = [r[1] for r in samples]
        centroids, least = fit(names, counted, clusters), calibrate(names, counted, clusters, reject_share)
        known = centroids, np.array([least.get(lang, 0.0) for lang in centroids.languages])
    model = spark.sparkContext.broadcast(known)
    columns = [id_col, "lang_pred", "score", "rejected"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            texts = batch.column(1)
            langs, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            todo = [i for i in range(len(texts)) if held and has_letter(texts[i].as_py())]
            for at in range(0, len(todo), 128):
                part = todo[at : at + 128]
                own, cosine = held[0].nearest(np.array([counts(texts[i].as_py()) for i in part]))
                scores[part], rejected[part] = cosine, cosine < held[1][own]
                for i, k in zip(part, own, strict=True):
                    langs[i] = held[0].languages[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], columns)

    source = rows.select("id", "text")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(label, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
