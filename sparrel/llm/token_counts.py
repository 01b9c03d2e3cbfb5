"""Token counts as an exact length histogram.

Each batch folds its documents' encoded lengths into (length, count) pairs before anything is
shuffled. Suffix sums over the distinct lengths then answer, for every context limit, how many
documents and tokens lie at or beyond it and how many tokens are left when each document is cut
there. Distinct lengths are few: d of them need at least d*d/2 tokens.

Defined cases: a null or empty text has length 0 and is counted; repeated rows count as often as
they occur; an empty table has an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrel.llm.tokens import encoder


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, n = np.unique(encoder(tokenizer).lengths(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], ["length", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "length long, n long")
    return found.groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """Per length: docs and tokens at or beyond it, tokens when cut there, and the share of documents up to it."""
    beyond = Window.orderBy(F.desc("length"))
    up_to = Window.orderBy("length")
    everything = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("length") * F.col("n_docs")
    below = F.sum(tokens).over(everything) - F.sum(tokens).over(beyond)
    return histogram.select(
        "length",
        "n_docs",
        F.sum("n_docs").over(beyond).alias("docs_at_least"),
        F.sum(tokens).over(beyond).alias("tokens_at_least"),
        (below + F.col("length") * F.sum("n_docs").over(beyond)).alias("truncated_total"),
        (F.sum("n_docs").over(up_to) / F.sum("n_docs").over(everything)).alias("share_up_to"),
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row ``tokens``: the total when every document is cut at ``limit``, from the context table."""
    next_up = table.filter(F.col("length") >= limit).agg(F.min_by("truncated_total", "length").alias("t"), F.min("length").alias("l"), F.min_by("docs_at_least", "length").alias("d"))
    everything = table.agg(F.coalesce(F.max("truncated_total"), F.lit(0)).alias("all"))
    # Between two lengths the total is linear: all documents at or beyond the next length are cut.
    return next_up.join(F.broadcast(everything)).select(F.coalesce(F.col("t") - (F.col("l") - limit) * F.col("d"), F.col("all")).alias("tokens"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """One row ``length``: the smallest length that a share ``q`` of the documents does not exceed; null without documents."""
    return table.filter(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))
