"""Toxicity by bags of subwords averaged into a linear softmax.

A text is the mean of the embeddings of all its byte n-grams, repeats included,
and a softmax layer over it is trained jointly with the embeddings in numpy, so an
unseen misspelling shares the vectors of the n-grams it keeps.  Embeddings are
shrunk as whole rows while they are trained, so all but some hundreds of n-grams
end at zero: a few telling words then show in the mean of a long text too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kvlake.llm.langid import bounded_sample
from kvlake.llm.ngrams import hashed, plain
from kvlake.llm.storage import Scratch, prepare_workers, unused

BITS, ORDERS = 18, (3, 4, 5)
#: Rejecting a clean text weighs as much as passing so many toxic ones.
_CLEAN_WEIGHT = 3.0
#: The softmax layer's input is the mean times this; shares of n-grams are small numbers.
_SCALE = 30.0
#: Shrinkage of an embedding, as a share of the largest first gradient of one.
_SHRINK = 0.2
#: Weight of the text without n-grams among the clean ones, both classes weighing 0.5.
_EMPTY_WEIGHT = 0.05
#: Characters that are scored together.
_TOGETHER = 1 << 19


def bags(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of several whole texts in a row, and how many each text has.

    Texts come in groups of about ``_TOGETHER`` characters, to bound memory.
    """
    part, size = [], 0
    for i, text in enumerate(texts):
        part.append(plain(text))
        size += len(part[-1])
        if size >= _TOGETHER or i + 1 == len(texts):
            yield _buckets(part)
            part, size = [], 0


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())  # bytes to the text's end
    data = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.stack([left >= n for n in ORDERS], axis=1)
    found = np.stack([hashed(data, n, BITS).astype(np.int32) for n in ORDERS], axis=1)[inside]
    return found, sum(np.maximum(size - n + 1, 0) for n in ORDERS)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` values each, in a row; of none, zero."""
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: a number per bucket, a bias."""

    value: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """The softmax of each text's mean; its sum runs over its own n-grams only."""
        parts = [_sums(self.value.take(found), counts) / np.maximum(counts, 1) for found, counts in bags(texts)]
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]) + self.bias, -60, 60)))


def _shares(texts: Sequence[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Buckets that three texts hold at least, and of each group of texts: their places, shares, and numbers by text.

    What fewer texts hold says more about one text than about its class.
    """
    blocks, held = [], np.zeros(1 << BITS, np.int64)
    for found, sizes in bags(texts):
        place, share = [], []
        for one in np.split(found, np.cumsum(sizes)[:-1]):
            bucket, times = np.unique(one, return_counts=True)
            place.append(bucket)
            share.append((times / max(1, len(one))).astype(np.float32))
        blocks.append((np.concatenate(place), np.concatenate(share), np.array([len(x) for x in place])))
        held += np.bincount(blocks[-1][0], minlength=1 << BITS)
    common = held >= 3
    at = (np.cumsum(common) - 1).astype(np.int32)
    for i, (bucket, part, counts) in enumerate(blocks):
        kept = common[bucket]
        blocks[i] = at[bucket[kept]], part[kept], _sums(kept.astype(np.int64), counts).astype(np.int64)
    return np.flatnonzero(common), blocks


def train(texts: Sequence[str], labels: Sequence[int], size: int = 8, epochs: int = 400, seed: int = 11, shrink: float = _SHRINK) -> Model:
    """Embeddings and softmax by full-batch gradient steps on the means of whole texts.

    Classes weigh alike, and the text without n-grams counts as a clean one.  Each
    step is scaled by the largest gradient so far and then shrinks every embedding
    by the same length.  The bias is set where the training texts part best, a clean
    one weighing as ``_CLEAN_WEIGHT``, and above the text without n-grams.  Where
    shrinking leaves no embedding, half of it is tried.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), float(20.0 * (y.mean() - 0.5)) if len(y) else -20.0)
    names, blocks = _shares(texts)
    blocks = [(place, share * np.float32(_SCALE), counts) for place, share, counts in blocks]
    ends = np.cumsum([len(counts) for _, _, counts in blocks])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    rng = np.random.default_rng(seed)
    embed, soft, bias = np.zeros((len(names), size)), rng.normal(0, 0.5, (2, size)), np.zeros(2)
    params, penalty = [embed, soft, bias], 0.0
    moments = [(np.zeros_like(p), [0.0]) for p in params]

    def logits() -> np.ndarray:
        value = (embed @ (soft[1] - soft[0])).astype(np.float32)
        return np.concatenate([_sums(share * value[place], counts) for place, share, counts in blocks])

    def error(logit: np.ndarray | float, truth: np.ndarray | float) -> np.ndarray | float:
        return 1.0 / (1.0 + np.exp(-np.clip(logit + bias[1] - bias[0], -60, 60))) - truth

    for turn in range(1, epochs + 1):
        err = error(logits(), y) * weight
        tilt, lean = soft[1] - soft[0], err.sum() + error(0.0, 0.0) * _EMPTY_WEIGHT
        pull = np.zeros(len(names))
        for (place, share, counts), own in zip(blocks, np.split(err.astype(np.float32), ends[:-1]), strict=True):
            pull += np.bincount(place, share * np.repeat(own, counts), minlength=len(names))
        mean_pull = pull @ embed
        grads = [pull[:, None] * tilt, np.stack([-mean_pull, mean_pull]) + 1e-4 * soft, np.array([-lean, lean])]
        penalty = penalty or shrink * float(np.abs(pull).max(initial=0.0) * np.sqrt(tilt @ tilt))
        for param, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v[0] += 0.001 * (float(np.square(grad).max(initial=0.0)) - v[0])
            step = 0.05 / (np.sqrt(v[0] / (1 - 0.999**turn)) + 1e-8)
            param -= step * m / (1 - 0.9**turn)
            if param is embed:
                norm = np.sqrt(np.square(embed).sum(axis=1))
                embed *= np.maximum(0.0, 1.0 - step * penalty / np.maximum(norm, 1e-12))[:, None]
    if shrink > 1e-4 and not embed.any():
        return train(texts, labels, size, epochs, seed, shrink / 2)
    value = np.zeros(1 << BITS)
    value[names] = (embed @ (soft[1] - soft[0])).astype(np.float32) * _SCALE
    # The text without n-grams has logit 0; its loss is more than all toxic texts can win.
    logit, lost = np.append(logits(), 0.0), np.append(np.where(y > 0, -weight, _CLEAN_WEIGHT * weight), 1.0)
    order = np.argsort(logit, kind="stable")
    gain = np.concatenate([[0.0], np.cumsum(lost[order])])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edge = np.concatenate([[logit[order[0]] - 1], (logit[order][1:] + logit[order][:-1]) / 2, [logit[order[-1]] + 1]])
    return Model(value, -float(edge[best[len(best) // 2]]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1200,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    remainder: int = 0,
    modulus: int = 5,
    class_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Learns from labels of rows whose CRC-32 of the id modulo ``modulus`` is not
    ``remainder``, at most ``per_class`` of each class (those with the smallest
    hash of their id), less those with which the texts of a class would pass
    ``class_bytes``; an id labelled twice counts as toxic if any label does.  The
    score of each row depends on its whole text alone.  Null and empty texts are
    scored as the text without n-grams.  A null id is not held out and never
    learned from.  Without labels of both classes the score is that of the only
    class, or 0 where there is none.  Repeated rows each get a score, other
    columns are ignored, and an empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))
    model = fit_labels(docs, labels, per_class, id_col, text_col, label_col, remainder, modulus, class_bytes)
    scored = _with_scores(docs.select(F.col(id_col), F.col(text_col).alias("text"), held.alias("held_out")), model, "text", "score")
    return scored.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit_labels(
    docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str, remainder: int, modulus: int, class_bytes: int
) -> Model:
    """The model of the bounded sample that ``score_toxicity`` describes."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    learn = F.crc32(F.col("id").cast("string")) % modulus != remainder
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    marked = marked.where(learn).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    picked = bounded_sample(marked, "y", per_class, scratch)
    found = scratch.table(rows.join(F.broadcast(picked), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "y").distinct(), "texts")
    sizes = found.select("id", "y", F.xxhash64(F.lit(5), "id").alias("h"), F.octet_length("text").alias("size")).collect()
    spent: dict[int, int] = {}
    within = set()
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"], r["size"])):
        if spent.get(r["y"], 0) + r["size"] <= class_bytes:
            spent[r["y"]] = spent.get(r["y"], 0) + r["size"]
            within.add((r["id"], r["size"]))
    longest = max((size for _, size in within), default=0)
    sample = found.where(F.octet_length("text") <= longest).collect() if len(within) < len(sizes) else found.collect()
    sample = sorted((r["id"], r["text"], r["y"]) for r in sample if len(within) == len(sizes) or (r["id"], len(r["text"].encode())) in within)
    return train([r[1] for r in sample], [int(r[2] > 0) for r in sample])


def _with_scores(rows: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``rows`` and the score of each one's whole text, under a name that no column has."""
    spark = rows.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
    at = rows.columns.index(text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = known.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return rows.mapInArrow(rate, schema)


def clean_rows(
    docs: DataFrame, labels: DataFrame, per_class: int = 1200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", class_bytes: int = 4 << 20
) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns and no other.

    The model is that of ``score_toxicity``, and so are nulls, empty texts and
    repeated labels.  Repeated rows all stay or go, a column named like the score
    stays as it is, and an empty table gives an empty result.
    """
    model = fit_labels(docs, labels, per_class, id_col, text_col, label_col, 0, 5, class_bytes)
    (name,) = unused(docs, "score")
    return _with_scores(docs, model, text_col, name).where(F.col(name) < 0.5).drop(name)
