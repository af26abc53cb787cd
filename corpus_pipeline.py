"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept; ``run`` writes each result as a table in the shared folder and
reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import exactdedup, mixing, packing, simhash, toxicity
from kvlake.llm.storage import Scratch

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts are scored as texts without n-grams, rows with a null id
    are scored like others, repeated rows all stay or go, and columns beside
    those of documents go.  An empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_rows(docs.select(*_COLUMNS), labels)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest doc_id.

    Rows that share that id, or are all without one, are tied: of these the one
    with the smallest columns stays.  A null text equals the empty one.  Columns
    beside those of documents go, and an empty table gives an empty result.
    """
    return exactdedup.without_duplicates(docs.select(*_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8).

    The text with the smallest id stays, a null id being larger than any; rows of
    one text all stay or go, and texts without words, null ones included, are one
    group.  Columns beside those of documents go, and an empty table gives an
    empty result.
    """
    return simhash.without_near_duplicates(docs.select(*_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources up to four times.

    A null source is a source of its own, a source without words comes out once,
    and rows that share an id are drawn together.  Columns beside those of
    documents go, and an empty table gives an empty result.
    """
    mixed = mixing.temperature_mix(docs.select(*_COLUMNS), repetition_limit=4.0, keep_all=True, positions=False)
    return mixed.select(*_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches.

    Null and empty texts make a sequence of no words, repeated rows are packed as
    often as they occur, ids may be null, columns other than the id and the text
    are ignored, and an empty table gives an empty result.
    """
    return packing.pack_buckets(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained model and permutations by hash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
