r"""Line deduplication in DataFrame operations only.

Lines become 128-bit hashes of their keys. Hashes are range-partitioned and sorted by document and
position within each hash, and a window streams over each run: a line that differs in document from
its predecessor is the document's first occurrence. A hash's lines are spread over ``spread``
sub-ranges by document, so a line that a third of all documents share fills many partitions; the
sub-results meet as one row each. What comes back is a run-length bitmap of kept lines per document
(``keep_bitmaps``), built from hashes and positions alone; ``drop_repeated_lines`` applies it to texts.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points
are never dropped; rows equal in id and text are one document; null ids are ordinary ids; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrel.llm.common import SPACES, broadcast_within, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    r"""A line without [\x20\x09-\x0D] at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, tie, lines, pos, h1, h2) for each line whose key has ``min_chars`` code points.

    ``tie`` tells texts of one id apart, ``lines`` is the number of the document's lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tie"), _lines(F.col(text_col)).alias("split"))
    rows = split.select("doc", "tie", F.size("split").alias("lines"), F.posexplode("split").alias("pos", "line"))
    keyed = rows.select("doc", "tie", "lines", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= max(1, min_chars))
    return keyed.select("doc", "tie", "lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int, spread: int) -> DataFrame:
    """(h1, h2, first) of keys found in ``min_docs`` documents; ``first`` is the first (doc, tie, pos)."""
    ranged = lines.withColumn("sub", F.pmod(F.xxhash64("doc"), F.lit(spread))).repartitionByRange("h1", "h2", "sub")
    run = Window.partitionBy("h1", "h2", "sub").orderBy("doc", "tie", "pos")
    new = (F.row_number().over(run) == 1) | ~F.lag("doc").over(run).eqNullSafe(F.col("doc")) | (F.lag("tie").over(run) != F.col("tie"))
    firsts = ranged.withColumn("new", new).filter("new")
    place = F.struct("doc", "tie", "pos")
    parts = firsts.groupBy("h1", "h2", "sub").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_docs).select("h1", "h2", "first")


def _runs(dropped: Column, lines: Column) -> Column:
    """(start, length) of each run of kept lines between sorted dropped positions."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(lines))
    runs = F.zip_with(starts, ends, lambda start, end: F.struct(start.alias("start"), (end - start).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, spread: int = 64
) -> DataFrame:
    """(doc, tie, n_dropped, keep_runs) of documents that lose any line, without their texts.

    ``keep_runs`` is the run-length bitmap of the lines that stay: (start, length) of each run.
    ``keep_first`` keeps the first occurrence of each repeated key; without it all of them go.
    """
    # Texts are split and hashed once: ranges are sampled, dealt and joined from the written hashes.
    lines = materialize(occurrences(docs, id_col, text_col, min_chars), "lines")
    repeated = broadcast_within(materialize(repeated_lines(lines, min_docs, spread), "repeated"))
    hit = lines.join(repeated, ["h1", "h2"])
    if keep_first:
        hit = hit.filter(~F.struct("doc", "tie", "pos").eqNullSafe(F.col("first")))
    found = hit.groupBy("doc", "tie", "lines").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return found.select("doc", "tie", F.size("dropped").alias("n_dropped"), _runs(F.col("dropped"), F.col("lines")).alias("keep_runs"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, spread: int = 64
) -> DataFrame:
    """(id, n_lines, n_dropped, keep_runs, kept_text) per row: the bitmaps, applied to the texts."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first, spread)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tie"))
    joined = rows.join(bitmaps, F.col(id_col).eqNullSafe(F.col("doc")) & (F.col("_tie") == F.col("tie")), "left").withColumn("_lines", _lines(F.col("_text")))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice("_lines", r["start"] + 1, r["length"])))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("_lines").alias("length")))
    return joined.select(
        F.col(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("keep_runs", whole).alias("keep_runs"),
        F.when(F.col("keep_runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
