"""Benchmark decontamination with spaced seeds.

Text becomes words (A-Z lower-cased, ASCII punctuation ends words). A window of ``span`` words is cut
into four equal parts; each of six fixed masks reads two parts and ignores the words of the others, so
a window with up to two substituted words still agrees with its source under some mask. Mask hashes
of the benchmark and of the documents are joined; a bit table of fixed size, filled from the
benchmark, keeps document hashes that cannot join out of the shuffle. Each joined pair of a document
and an item is verified around its hits: hits fold to distinct shifts, at each shift the two texts
are laid side by side, and a window counts as an overlap if at most ``span // 6`` words differ. Hashes
only choose what is laid side by side: an overlap counts after the words themselves were compared.

Items shorter than 12 words use windows of 8 or 4 words; items shorter than 4 words are looked for
as they are, without substitutions.

Defined cases: null and empty texts overlap with nothing, and so do items without words; repeated
rows are reported as often as they occur; benchmark rows that repeat an id and a text are one item;
null ids are reported as null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import broadcast_within, free_worker, materialize
from sparrel.llm.shingles import _LOWER, chunks, hash_words, mix, windows, word_hashes, word_places

SPANS = (12, 8, 4, 3, 2, 1)
MASKS = tuple(combinations(range(4), 2))
_WEIGHTS = mix(np.arange(7, 7 + 2 * len(MASKS), dtype=np.uint64)).reshape(-1, 2) | np.uint64(1)
#: The bit table has at most so many bits (32 MB), whatever the benchmark's size.
_MOST_BITS = 28
_SLAB = 1 << 18
_FOUND = "doc_id long, tie long, item_id long, doc_start long, item_start long, length long, matched long, n long"


def span_of(words: int) -> int | None:
    """The window of an item of so many words."""
    return next((s for s in SPANS if words >= s), None)


def mask_hashes(words: np.ndarray, span: int) -> np.ndarray:
    """One row per mask: the hash of the words it reads in each window of ``span`` words. Windows below 4 words have one mask that reads all."""
    own = mix(np.array([span], np.uint64))
    if span < 4:
        return (windows(words, span) ^ own)[None]
    size = span // 4
    parts = windows(words, size)
    n = len(words) - span + 1
    if n <= 0:
        return np.empty((len(MASKS), 0), np.uint64)
    return np.stack([mix(parts[a * size : a * size + n] * w[0] + parts[b * size : b * size + n] * w[1]) ^ own for (a, b), w in zip(MASKS, _WEIGHTS, strict=True)])


class BitTable:
    """Whether a hash may be one of the benchmark's."""

    def __init__(self, bits: int, places: np.ndarray) -> None:
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << max(0, bits - 3), np.uint8)
        np.bitwise_or.at(self.table, places >> 3, (1 << (places & 7)).astype(np.uint8))

    def hits(self, words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, hash) of all mask hashes that may join, a stretch of words at a time."""
        at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for first in range(0, len(words) - span + 1, _SLAB):
            hashes = mask_hashes(words[first : first + _SLAB + span - 1], span)
            place = (hashes >> self.shift).astype(np.int64)
            rows, columns = np.nonzero(self.table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            at.append(columns + first)
            found.append(hashes[rows, columns])
        return np.concatenate(at), np.concatenate(found)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        for first, _, data, offsets in chunks(texts):
            words, places = word_hashes(data, offsets, punctuation=False)
            for n in range(len(offsets) - 1):
                own = words[places[n] : places[n + 1]]
                if span := span_of(len(own)):
                    seeds = np.unique(mask_hashes(own, span))
                    row = batch.slice(first + n, 1).select(["item_id", "item_tie"])
                    at = pa.array(np.zeros(len(seeds), np.int64))
                    yield pa.RecordBatch.from_arrays([row.column(0).take(at), row.column(1).take(at), pa.array(np.full(len(seeds), span, np.int32)), pa.array(seeds.view(np.int64))], ["item_id", "item_tie", "span", "hash"])


def _document_seeds(table, spans: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        bits = table.value
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1)
            for first, _, data, offsets in chunks(batch.column(2)):
                words, places = word_hashes(data, offsets, punctuation=False)
                for span in spans:
                    at, found = bits.hits(words, span)
                    text = np.searchsorted(places, at, "right") - 1
                    inside = at + span <= places[text + 1]
                    pairs = np.unique(np.stack([text[inside], found[inside].view(np.int64)], 1), axis=0)
                    if len(pairs):
                        rows = pa.array(pairs[:, 0] + first)
                        yield pa.RecordBatch.from_arrays([ids.take(rows), ties.take(rows), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["doc_id", "tie", "hash"])

    return run


class Words:
    """A text's words as hashes and, where asked for, as bytes."""

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode()
        data = np.frombuffer(self.raw, np.uint8)
        self.first, self.last, _ = word_places(data, np.array([0, len(data)]), punctuation=False)
        self.lower = _LOWER[data]
        self.hashes = hash_words(self.lower, self.first, self.last)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.hashes)

    def word(self, n: int) -> bytes:
        return self.lower[self.first[n] : self.last[n] + 1].tobytes()

    def hits(self, bits: BitTable, span: int) -> tuple[np.ndarray, np.ndarray]:
        if span not in self.seeds:
            self.seeds[span] = bits.hits(self.hashes, span)
        return self.seeds[span]


def best_overlap(doc: Words, item: Words, bits: BitTable) -> tuple[int, int, int, int] | None:
    """(doc_start, item_start, length, matched) of the overlap with the most equal words, the first of several."""
    span = span_of(len(item))
    if span is None:
        return None
    at, found = doc.hits(bits, span)
    own = mask_hashes(item.hashes, span)
    # Which shifts have a hit: one mark per shift, however many hits agree on it.
    shifts = np.zeros(len(doc) + len(item) + 1, bool)
    order = np.argsort(found, kind="stable")
    at, found = at[order], found[order]
    for seeds in own:
        low, high = np.searchsorted(found, seeds, "left"), np.searchsorted(found, seeds, "right")
        for place in np.nonzero(high > low)[0].tolist():
            shifts[at[low[place] : high[place]] - place + len(item)] = True
    best = None
    ones = np.ones(span, np.int32)
    for shift in (np.nonzero(shifts)[0] - len(item)).tolist():
        start, end = max(0, shift), min(len(doc), shift + len(item))
        same = doc.hashes[start:end] == item.hashes[start - shift : end - shift]
        for exact in (False, True):
            if exact:
                same = np.array([bool(s) and doc.word(start + n) == item.word(start + n - shift) for n, s in enumerate(same)])
            run = np.convolve(same, ones, "valid") if len(same) >= span else np.empty(0, int)
            good = np.nonzero(run >= span - span // 6)[0]
            if not len(good):
                break
            a, b = int(good[0]), int(good[-1]) + span
            offer = (start + a, start + a - shift, b - a, int(same[a:b].sum()))
            if best and (offer[3], -offer[0]) <= (best[3], -best[0]):
                break
        else:
            best = offer
    return best


def _verify(table):
    names = ["doc_id", "tie", "item_id", "doc_start", "item_start", "length", "matched", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, tie, item_id, n, text): a document, then its items."""
        free_worker()
        bits, key, doc = table.value, None, None
        for batch in batches:
            out = []
            for doc_id, tie, kind, item_id, n, text in zip(*[batch.column(c).to_pylist() for c in range(5)], batch.column(5), strict=True):
                if kind == 0:
                    if (doc_id, tie) != key:
                        key, doc = (doc_id, tie), Words(text.as_py())
                elif found := best_overlap(doc, Words(text.as_py()), bits):
                    out.append((doc_id, tie, item_id, *found, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that repeat leave a task once."""
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def keyed_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``overlaps`` once per distinct (doc_id, tie), with ``n``, the rows that share them; ``tie`` is the hash of the text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("item_text")).withColumn("item_tie", F.xxhash64("item_text"))
    items = materialize(items.dropDuplicates(["item_id", "item_tie"]).select("item_id", "item_tie", "item_text"), "benchmark")
    seeds = materialize(items.mapInArrow(_item_seeds, "item_id long, item_tie long, span int, hash long"), "benchmark-seeds")
    count = seeds.count()
    bits = min(_MOST_BITS, max(16, (64 * count).bit_length()))
    # At most 2**bits small numbers, whatever the benchmark's size.
    places = seeds.select(F.shiftrightunsigned("hash", 64 - bits).alias("place")).distinct().toArrow().column(0).to_numpy()
    table = spark.sparkContext.broadcast(BitTable(bits, places))
    spans = [r.span for r in seeds.select("span").distinct().collect()]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    hits = rows.mapInArrow(_document_seeds(table, spans), "doc_id long, tie long, hash long")
    hits = materialize(hits.groupBy("doc_id", "tie", "hash").agg(F.count(F.lit(1)).alias("n")), "document-seeds")
    joined = hits.join(broadcast_within(seeds.select("item_id", "item_tie", "hash")), "hash")
    pairs = materialize(joined.groupBy("doc_id", "tie", "item_id", "item_tie").agg(F.max("n").alias("n")), "pairs")
    found = broadcast_within(materialize(pairs.select(F.col("doc_id").alias("d"), F.col("tie").alias("t")).distinct(), "hit-documents"))
    none = F.lit(None).cast("long")
    texts = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", F.lit(0).alias("kind"), none.alias("item_id"), none.alias("n"), "text")
    texts = texts.mapInArrow(_once, "doc_id long, tie long, kind int, item_id long, n long, text string")
    own = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_tie") == F.col("it"))
    wanted = pairs.join(broadcast_within(items).withColumnsRenamed({"item_id": "i", "item_tie": "it"}), own).select("doc_id", "tie", F.lit(1).alias("kind"), "item_id", "n", F.col("item_text").alias("text"))
    met = texts.unionByName(wanted).repartition("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "kind")
    return met.mapInArrow(_verify(table), _FOUND)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and item that share a window: its best overlap, in words from 0."""
    found = keyed_overlaps(docs, benchmark, id_col, text_col, item_col)
    times = F.explode(F.sequence(F.lit(1), F.col("n")))
    return found.withColumn("_time", times).select("doc_id", "item_id", "doc_start", "item_start", "length", "matched")


def contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """(doc_id, tie) of the documents that overlap with any item; ``tie`` is the hash of the text, null as empty."""
    return keyed_overlaps(docs, benchmark, **names).select("doc_id", "tie").distinct()
