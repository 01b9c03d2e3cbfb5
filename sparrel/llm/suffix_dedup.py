"""Removal of long repeated byte strings with bucketed suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. Sorting all
suffixes of a corpus in one place is out of reach, so strings first meet in buckets that lose none:

1. The anchor of a string is the place in it whose short gram hashes lowest. Equal strings have equal
   anchors, and the strings of one anchor start in one run; an anchor's context is what they cover.
2. Anchors whose gram occurs once are done. Contexts equal as a whole, by a 128-bit cryptographic
   digest of their bytes, stand for each other: one of them goes on.
3. Contexts are cut into classes of ``STEP`` neighbouring starts. All strings of a class share a core.
   Classes whose core, by such a digest, is found twice make buckets: a member is its few bytes left of
   the core, one symbol for the core, and its few bytes right of it. Each bucket is suffix-sorted (see
   suffix_sort), and neighbours whose common prefix covers ``STEP`` symbols are the repeats: the order
   of suffixes decides every repeat between contexts that differ.

A bucket of more than ``bucket`` members is split: its members become single strings, those that are
equal fold to two before the shuffle, the strings are dealt to as many buckets as the bound needs and
suffix-sorted there, and what is found holds for all that were folded. So no task holds an unbounded
group. Long texts are read a stretch at a time.

Defined cases: a null text is empty; texts shorter than ``width`` keep all bytes; rows that repeat an
id and a text repeat each other; null ids are ordinary ids; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import broadcast_within, discard, free_worker, materialize, partitions
from sparrel.llm.shingles import _ORDER, chunks, mix
from sparrel.llm.suffix_sort import common_prefixes, suffix_array

GRAM = 32
STEP = 13
_CORE = 256
_STRETCH = 1 << 22


def _digests(raw: bytes, starts: list[int], stops: list[int]) -> pa.Array:
    new = hashlib.blake2b
    return pa.array([new(raw[a:b], digest_size=16).digest() for a, b in zip(starts, stops, strict=True)], pa.binary())


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on. Equal hashes of other grams only make buckets larger."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    total = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        total += eight[8 * k : 8 * k + n] * _ORDER[k]
    return mix(total)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, gram, place, low, high) of each anchor; places count from the first byte, low to high are its strings' starts."""
    n, empty = len(data), np.empty(0, np.int64)
    sizes = np.diff(offsets)
    if n < width or not (sizes >= width).any():
        return empty, empty.view(np.uint64), empty, empty, empty
    grams = _grams(data)
    bits = np.uint64(int(n).bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    reach = width - GRAM + 1
    step = 1
    while 2 * step <= reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if reach > step:
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # strings that start in a text and end in the same text
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(chosen)]
    valid = np.nonzero(np.arange(len(chosen)) + width <= offsets[text + 1])[0]
    own, text = chosen[valid], text[valid]
    edge = np.nonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])))[0]
    low, high = valid[edge], valid[np.append(edge[1:], len(valid)) - 1]
    place, text = own[edge], text[edge]
    return text, grams[place], place, low, high


def _anchors(width: int, stretch: int = _STRETCH):
    names = ["gram", "context", "doc", "tie", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1)
            for first, _, data, offsets in chunks(batch.column(2)):
                # A run of starts that a stretch's end cuts makes two anchors of one gram; their classes still meet all others.
                for at in range(0, max(1, len(data) - width + 1), stretch) if len(offsets) == 2 else (0,):
                    part = data[at : at + stretch + width - 1] if len(offsets) == 2 else data
                    text, gram, place, low, high = anchors(part, np.array([0, len(part)]) if len(offsets) == 2 else offsets, width)
                    context = _digests(part.tobytes(), low.tolist(), (high + width).tolist())
                    base = (offsets[text] if len(offsets) > 2 else 0) - at
                    span = pa.array(low - base << 32 | place - low << 16 | high - low)
                    rows = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), context, ids.take(rows), ties.take(rows), span], names)

    return run


def _classes(width: int):
    """Members (text and its anchors) to class rows."""
    names = ["class", "core", "doc", "tie", "at", "skip", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column("text")[row].as_py().encode()
                spans = batch.column("spans").slice(row, 1).flatten().to_numpy()
                for part in range(0, len(spans), 20_000):
                    span = spans[part : part + 20_000]
                    low = span >> 32
                    place, high = low + (span >> 16 & 0xFFFF), low + (span & 0xFFFF)
                    count = -(-(width - GRAM + 1) // STEP)
                    number = np.tile(np.arange(count), len(span))
                    place, low, high = (np.repeat(x, count) for x in (place, low, high))
                    at = place - number * STEP - (STEP - 1)  # the class's first start; its last is at + STEP - 1
                    skip, last = np.maximum(0, low - at), np.minimum(STEP - 1, high - at)
                    keep = np.nonzero(skip <= last)[0]
                    number, at, skip, last = (x[keep] for x in (number, at, skip, last))
                    core, stop = (at + STEP - 1).tolist(), (at + width).tolist()
                    lefts = [raw[a:b] for a, b in zip((at + skip).tolist(), core, strict=True)]
                    rights = [raw[a:b] for a, b in zip(stop, (at + width + last).tolist(), strict=True)]
                    one = pa.array(np.zeros(len(keep), np.int64) + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number.astype(np.int32)), _digests(raw, core, stop), batch.column("doc").take(one), batch.column("tie").take(one),
                         pa.array(at), pa.array(skip.astype(np.int32)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names)

    return run


def bucket_repeats(members: list[tuple[int, bytes, bytes]]) -> list[tuple[int, int, int]]:
    """(member, first, last) starts in the class that repeat. A member is (skip, left, right)."""
    text: list[int] = []
    places: list[tuple[int, int]] = []
    for n, (skip, left, right) in enumerate(members):
        for k in range(len(left) + 1):
            places.append((n, skip + k))
        text += left
        text.append(_CORE)
        text += right
        places += [(-1, 0)] * (len(right) + 1)
        text.append(_CORE + 1 + n)  # a separator of its own
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    repeats = [False] * len(text)
    for r, n in enumerate(shared):
        if n >= STEP:
            repeats[order[r]] = repeats[order[r - 1]] = True
    out: list[tuple[int, int, int]] = []
    for (n, k), again in zip(places, repeats, strict=True):
        if not again or n < 0:
            continue
        if out and out[-1][0] == n and out[-1][2] == k - 1:
            out[-1] = (n, out[-1][1], k)
        else:
            out.append((n, k, k))
    return out


def _sorted_buckets(keys: int):
    """Rows sorted by the first ``keys`` columns, then (doc, tie, at, skip, left, right): what repeats in each bucket, as (doc, tie, at, first, last)."""
    names = ["doc", "tie", "at", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def done() -> None:
            # rows that repeat an id and a text bring the same members: one of each stands for all
            own = list(dict.fromkeys(rows))
            if len(own) > 1:
                out.extend((*own[n][:3], a, b) for n, a, b in bucket_repeats([row[3:] for row in own]))

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for now, row in zip(zip(*columns[:keys], strict=True), zip(*columns[keys:], strict=True), strict=True):
                if now != key:
                    done()
                    if len(out) > 10_000:
                        yield batch_of()
                        out.clear()
                    key, rows = now, []
                rows.append(row)
        done()
        yield batch_of()

    return run


_REPEATS = "doc long, tie long, at long, first long, last long"


def _split_repeats(nodes: DataFrame) -> DataFrame:
    """Repeats within buckets of too many members (with ``parts``): single strings, equal ones folded to two, in so many buckets each."""
    start = F.explode(F.sequence(F.col("skip"), F.col("skip") + F.octet_length("left"))).alias("k")
    strings = nodes.select("class", "core", "parts", "doc", "tie", "at", "skip", "left", "right", start).filter(F.octet_length("right") >= F.col("k"))
    key = ["class", "core", "k", "l", "r"]
    strings = strings.select("class", "core", "parts", "k", F.expr("substring(left, k - skip + 1)").alias("l"), F.expr("substring(right, 1, k)").alias("r"), "doc", "tie", "at")
    place = F.struct("doc", "tie", "at")
    two = strings.groupBy(*key).agg(F.max("parts").alias("parts"), F.min(place).alias("a"), F.max(place).alias("b"))
    each = two.select(*key, "parts", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("p"))
    each = materialize(each.withColumn("sub", F.pmod(F.xxhash64("k", "l", "r"), "parts").cast("int")), "strings")
    dealt = each.select("class", "core", "sub", "p.doc", "p.tie", "p.at", F.col("k").alias("skip"), "l", "r")
    dealt = dealt.repartition("class", "core", "sub").sortWithinPartitions("class", "core", "sub")
    found = materialize(dealt.mapInArrow(_sorted_buckets(3), _REPEATS), "string-repeats")
    # The strings that repeat, and all that were folded into them.
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("doc", "tie", "at")]
    named = found.select(F.col("doc").alias("f_doc"), F.col("tie").alias("f_tie"), F.col("at").alias("f_at"), F.col("first").alias("f_k"))
    flat = each.select(*key, "p.doc", "p.tie", "p.at")
    repeated = flat.join(broadcast_within(named), same[0] & same[1] & same[2] & (F.col("k") == F.col("f_k"))).select(*key).distinct()
    repeated = broadcast_within(materialize(repeated, "repeated-strings"))
    return strings.join(repeated, key).select("doc", "tie", "at", F.col("k").cast("long").alias("first"), F.col("k").cast("long").alias("last"))


def repeated_spans(docs: DataFrame, width: int, bucket: int) -> DataFrame:
    """(doc, tie, start, stop): byte stretches, possibly overlapping, whose union is all that repeats. ``docs`` has doc, tie and text."""
    found = materialize(
        docs.filter(F.octet_length("text") >= width).mapInArrow(_anchors(width), "gram long, context binary, doc long, tie long, span long"), "anchors")
    # Each side of a join below is a written table, so a gram that a third of the anchors have can be split among tasks.
    twice = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "grams")
    some = materialize(found.join(twice, "gram"), "repeated-grams")
    discard(found)
    contexts = some.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tie", "span")).alias("one"))
    contexts = materialize(contexts, "contexts")
    low = F.shiftright("span", 32)
    # A context of over a quarter of an even task's rows would fill one: there are at most four times as many of those as partitions, so they are broadcast.
    even = (contexts.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(docs.sparkSession))
    large = contexts.filter((F.col("n") > 1) & (F.col("n") > even)).select("gram", "context", F.lit(True).alias("large"))
    others = contexts.filter((F.col("n") > 1) & (F.col("n") <= even)).select("gram", "context")
    marked = some.join(F.broadcast(large), ["gram", "context"], "left")
    equal = marked.filter("large").drop("large").unionByName(marked.filter("large IS NULL").drop("large").join(others, ["gram", "context"]))
    whole = equal.select("doc", "tie", low.alias("start"), (low + F.col("span").bitwiseAND(0xFFFF) + width).alias("stop"))
    mixed = materialize(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).filter("c > 1 AND least = 1").select("gram"), "mixed-grams")
    members = contexts.join(mixed, "gram").select("one.*").groupBy("doc", "tie").agg(F.collect_list("span").alias("spans"))
    members = materialize(members, "members")
    matched = docs.join(members.withColumnsRenamed({"doc": "d", "tie": "t"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    matched = matched.select("doc", "tie", "text", "spans")
    kinds = "class int, core binary, doc long, tie long, at long, skip int, left binary, right binary"
    nodes = materialize(matched.mapInArrow(_classes(width), kinds), "classes")
    key = ["class", "core"]
    parts = F.ceil(F.col("n") * STEP / bucket).cast("int")
    counts = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cores = materialize(counts.select(*key, F.when(F.col("n") > bucket, parts).otherwise(1).alias("parts")), "repeated-cores")
    again = materialize(nodes.join(cores, key), "repeated-classes")
    discard(nodes)
    small = again.filter("parts = 1").repartition(*key).sortWithinPartitions(*key)
    repeats = small.select(*key, "doc", "tie", "at", "skip", "left", "right").mapInArrow(_sorted_buckets(2), _REPEATS)
    if not cores.filter("parts > 1").isEmpty():
        repeats = repeats.unionByName(_split_repeats(again.filter("parts > 1")))
    return whole.unionByName(repeats.select("doc", "tie", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + width).alias("stop")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            kept, at, removed, runs = [], 0, 0, 0
            stop = -1
            for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                if a > stop:
                    kept.append(raw[at:a])
                    runs += 1
                    removed += b - a
                elif b > stop:
                    removed += b - stop
                at = stop = max(stop, b)
            kept.append(raw[at:])
            rows.append((doc, len(raw), removed, runs, b"".join(kept)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeats(docs: DataFrame, width: int = 200, bucket: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; ``kept`` holds the remaining bytes."""
    if not GRAM + STEP <= width < 1 << 16:
        raise ValueError(f"repeats of {GRAM + STEP} to {(1 << 16) - 1} bytes can be found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    spans = repeated_spans(rows, width, bucket)
    merged = materialize(spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    # Members and spans grow with the corpus, so texts are shuffled to them at every size.
    merged = merged.withColumnsRenamed({"doc": "d", "tie": "t"})
    joined = rows.join(merged, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return joined.select("doc", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    """The rows of ``drop_repeats`` with the kept bytes as their SHA-256."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

