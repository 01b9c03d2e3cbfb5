"""A corpus pipeline: language ID, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
Null ids, null and empty texts: language ID drops texts without letters, so later stages see none of
those; a row with a null id is kept unless a copy has an id; rows that repeat an id and a text stay
or go together, and rows of one id with other texts go by their own texts (near copies under one id
count as one document and stay). Extra columns ride along until packing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm import packing
from sparrel.llm.common import broadcast_within, materialize
from sparrel.llm.decontaminate import contaminated
from sparrel.llm.exact_dedup import exact_dedup
from sparrel.llm.langid import UNKNOWN, held_out, identify
from sparrel.llm.near_dedup import near_duplicates, text_tie

#: Documents whose best language has a smaller share than this are rejected.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are not in ``gone`` (doc_id, tie)."""
    left, right = docs.alias("_docs"), broadcast_within(gone).alias("_gone")
    same = F.col("_docs.doc_id").eqNullSafe(F.col("_gone.doc_id")) & (text_tie(F.col("_docs.text")) == F.col("_gone.tie"))
    return left.join(right, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that no learned language explains better than the others together."""
    found = identify(docs, docs.filter(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*[f"`{c}`" for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space keep the one with the smallest id."""
    return exact_dedup(docs).filter("kept").select(*[f"`{c}`" for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at a similarity of 0.8 over five-word shingles keep the smallest id."""
    groups = near_duplicates(docs, k=5, share=(80, 100))
    gone = materialize(groups.filter("doc_id <> component_id").select("doc_id", "tie").distinct(), "near-copies")
    return _without(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    found = materialize(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "contaminated")
    return _without(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096), capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A fitted model, similarity components and token ids are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
