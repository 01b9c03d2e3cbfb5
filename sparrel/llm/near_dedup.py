"""MinHash near-deduplication with one-permutation hashing.

A document's shingle hashes are cut into equal ranges; the smallest hash of each range is its
signature, and empty ranges copy a range chosen by a fixed sequence of hashes (optimal
densification). Bands of the signature make buckets. Documents with equal words (by a 128-bit
cryptographic digest) are one node throughout.

1. A bucket of n nodes adds the n-1 edges of a star, from its smallest node to the others. Each edge
   is settled by the shingles themselves, in groups of bounded size around the star's centre.
2. Links make components. What stars miss are pairs around a bucket's centre that are still in
   different components: buckets that hold such pairs, and only they, are compared exactly, in
   clusters cut into blocks of bounded size, through the shingles that documents share.

Hashes choose candidates and count; before a link counts, the common shingles are compared as words.

Defined cases: a text without words has no shingles and is linked with nothing; rows that repeat an
id go by their own texts; a null id is linked with nothing and its component is null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import broadcast_within, free_worker, materialize
from sparrel.llm.components import components
from sparrel.llm.shingles import Shingles, mix, shingled


def signature(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of 16-bit values per non-empty sorted set."""
    edges = (np.arange(bins + 1, dtype=object) * 2**64 // bins)[:-1].astype(np.uint64)
    values = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for n, s in enumerate(sets):
        at = np.append(np.searchsorted(s, edges), len(s))
        full[n] = at[1:] > at[:-1]
        values[n, full[n]] = s[at[:-1][full[n]]]
    rows = np.nonzero(~full.all(axis=1))[0]
    source_full, source = full.copy(), values.copy()
    place, attempt = np.arange(bins, dtype=np.uint64), 0
    while len(rows):
        attempt += 1
        other = (mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        fill = ~full[rows] & source_full[rows][:, other]
        values[rows] = np.where(fill, source[rows][:, other], values[rows])
        full[rows] |= fill
        rows = rows[~full[rows].all(axis=1)]
    return (mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(48)).astype(np.uint16)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of bucket keys per signature."""
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(1000, 1000 + bands, dtype=np.uint64))
    cut = signatures.astype(np.uint64).reshape(len(signatures), bands, rows)
    return mix((mix(cut) * weights).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)


def _sign(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            held: list[Shingles] = []
            first = 0

            def flush() -> pa.RecordBatch:
                some = [s.hashes for s in held if len(s.hashes)]
                keys = band_keys(signature(some, bands * rows), bands, rows) if some else np.empty((0, bands), np.int64)
                sizes = [len(s.hashes) for s in held]
                digests = [hashlib.blake2b(s.words, digest_size=16).digest() for s in held]
                ends = np.concatenate([[0], np.cumsum(np.array(sizes) > 0) * bands]).astype(np.int32)
                part = batch.slice(first, len(held))
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n", "digest", "keys"])

            for s in shingled(batch.column(2), k):
                held.append(s)
                if len(held) == 512:
                    yield flush()
                    first, held = first + len(held), []
            if held:
                yield flush()

    return sign


def similar(x: Shingles, y: Shingles, share: tuple[int, int]) -> bool:
    """Whether two sets reach the similarity, by hashes first and then by words."""
    part, whole = share
    a, b = len(x.hashes), len(y.hashes)
    if min(a, b) * whole < part * max(a, b):
        return False
    both = len(np.intersect1d(x.hashes, y.hashes, assume_unique=True))
    return whole * both >= part * (a + b - both) and _confirmed(x, y, share)


def _confirmed(x: Shingles, y: Shingles, share: tuple[int, int]) -> bool:
    part, whole = share
    both = x.agree(y)
    return whole * both >= part * (len(x.hashes) + len(y.hashes) - both)


def spanning_links(nodes: list[int], sets: list[Shingles], side: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents; with two sides (0, 1) only pairs across them are compared."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    part, whole = share
    sizes = np.array([len(s.hashes) for s in sets], np.int64)
    crossed = side.any()
    flat, owner = np.concatenate([s.hashes for s in sets]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    word = np.cumsum(new) - 1
    shared = np.bincount(word)[word] > 1  # a shingle of one document is in no intersection
    word, owner = word[shared], owner[shared]
    word = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1 if len(word) else word
    left = np.nonzero(side == 0)[0]
    right = np.nonzero(side == 1)[0] if crossed else left
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.empty(len(sets), np.int64)
    place[left] = np.arange(len(left))
    place_right = np.empty(len(sets), np.int64)
    place_right[right] = np.arange(len(right))
    width = 2048
    for first in range(0, int(word[-1]) + 1 if len(word) else 0, width):
        a, b = np.searchsorted(word, [first, first + width])
        w, o = word[a:b] - first, owner[a:b]
        x, on = np.zeros((len(left), width), np.float32), side[o] == 0
        x[place[o[on]], w[on]] = 1
        y = x
        if crossed:
            y = np.zeros((len(right), width), np.float32)
            y[place_right[o[~on]], w[~on]] = 1
        both += x @ y.T
    counts = both.astype(np.int64)
    hit = whole * counts >= part * (sizes[left][:, None] + sizes[right][None, :] - counts)
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = int(left[i]), int(right[j])
        if root(x) != root(y) and _confirmed(sets[x], sets[y], share):
            parent[root(x)] = root(y)
            links.append((nodes[x], nodes[y]))
    return links


def _groups(solve: Callable[[tuple, list[tuple[int, int, Shingles]]], Iterator[tuple[int, int]]], k: int):
    """Rows sorted by three key columns, then (node, block, text): each group's links. A node that comes again in a group is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        key, rows, seen = None, [], set()

        def done() -> pa.RecordBatch:
            found = list(solve(key, rows)) if len(rows) > 1 else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(5)]
            for x, y, z, node, block, s in zip(*columns, shingled(batch.column(5), k), strict=True):
                if (x, y, z) != key:
                    if key is not None:
                        yield done()
                    key, rows, seen = (x, y, z), [], set()
                if node not in seen:
                    seen.add(node)
                    rows.append((node, block, s))
        if key is not None:
            yield done()

    return run


def _star_links(share: tuple[int, int]):
    def solve(key: tuple, rows: list[tuple[int, int, Shingles]]) -> Iterator[tuple[int, int]]:
        centre = next(s for node, _, s in rows if node == key[0])
        return ((key[0], node) for node, _, s in rows if node != key[0] and similar(centre, s, share))

    return solve


def _block_links(share: tuple[int, int]):
    def solve(key: tuple, rows: list[tuple[int, int, Shingles]]) -> list[tuple[int, int]]:
        _, i, j = key
        side = np.array([0 if block == i else 1 for _, block, _ in rows]) if i != j else np.zeros(len(rows), int)
        return spanning_links([n for n, _, _ in rows], [s for _, _, s in rows], side, share)

    return solve


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that repeat (first four columns) leave a task once."""
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row in zip(*[batch.column(n).to_pylist() for n in range(4)], strict=True):
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _shape(share: tuple[int, int]) -> tuple[int, int]:
    """(bands, rows): a pair exactly at the threshold misses all buckets with a chance under one in a million."""
    similarity = share[0] / share[1]
    for rows in (8, 7, 6, 5, 4, 3, 2, 1):
        bands = next((b for b in range(1, 49) if (1 - similarity**rows) ** b < 4e-7), None)
        if bands:
            return bands, rows
    return 48, 1


def text_tie(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, k: int, share: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", block: int = 400_000, block_docs: int = 1500, star_docs: int = 100, spread: int = 8) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id) per row; ``tie`` is that of the row's text. ``share``: the least Jaccard similarity as (numerator, denominator).

    ``block``, ``block_docs``: the most shingles and documents of a block on average; a task holds two blocks.
    ``spread``: a cluster of over ``star_docs`` documents is cut into this many blocks at least, none under ``star_docs``, so that several tasks share it.
    ``star_docs``: the most documents that are compared with a star's centre in one group, on average.
    """
    bands, rows = _shape(share)
    part, whole = share
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_tie(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(source.mapInArrow(_sign(k, bands, rows), "doc_id long, tie long, n long, digest binary, keys array<long>"), "signatures")
    usable = signed.filter("n > 0 AND doc_id IS NOT NULL")
    folded = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("at"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(folded.select(F.monotonically_increasing_id().alias("node"), "digest", "at.doc_id", "at.tie", "n", "keys", "copies"), "classes")

    def linked_by(wanted: DataFrame, solve) -> DataFrame:
        """Links within groups of ``wanted`` (x, y, z, node, block); texts go to the groups that need them, once a task."""
        wanted = materialize(wanted, "wanted")
        placed = broadcast_within(materialize(wanted.join(classes.select("node", "doc_id", "tie"), "node"), "placed"))
        columns = ["x", "y", "z", "node", "block", "text"]
        met = source.join(placed, ["doc_id", "tie"]).select(*columns).mapInArrow(_once, "x long, y int, z int, node long, block int, text string")
        grouped = met.repartition("x", "y", "z").sortWithinPartitions("x", "y", "z")
        return materialize(grouped.mapInArrow(_groups(solve, k), "a long, b long"), "links")

    buckets = classes.select("node", "n", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).filter("hub.node <> last").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    hubs = broadcast_within(materialize(hubs, "hubs"))
    entries = materialize(buckets.join(hubs, "key").filter("node <> hub").select("key", "hub", "hub_n", "node", "n"), "stars")
    large_enough = F.least("n", "hub_n") * whole >= F.greatest("n", "hub_n") * part
    edges = materialize(entries.filter(large_enough).groupBy("hub", "node").agg(F.max("n").alias("n")), "star-edges")
    shared = F.least(F.lit(spread), F.ceil(F.count(F.lit(1)) / star_docs))
    few = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count(F.lit(1)) / block_docs), shared).cast("int")
    groups = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count(F.lit(1)) / star_docs)).cast("int")
    sizes = broadcast_within(materialize(edges.groupBy("hub").agg(groups.alias("groups")), "star-sizes"))
    dealt = edges.join(sizes, "hub").select(F.col("hub").alias("x"), F.pmod(F.xxhash64("node"), "groups").cast("int").alias("y"), "node")
    centres = sizes.select(F.col("hub").alias("x"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("y"), F.col("hub").alias("node"))
    zero = F.lit(0)
    links = linked_by(dealt.unionByName(centres).select("x", "y", zero.alias("z"), "node", zero.alias("block")), _star_links(share))
    linked = broadcast_within(materialize(components(links), "linked"))

    # Around a centre all is settled if the others are in one component.
    here = F.coalesce("component", "node")
    open_keys = entries.join(linked, "node", "left").groupBy("key").agg(F.min(here).alias("low"), F.max(here).alias("high"), F.min("node").alias("a")).filter("low <> high").select("key", "a")
    open_keys = broadcast_within(materialize(open_keys, "open-buckets"))
    rest = materialize(entries.join(open_keys, "key").select("a", "node").distinct(), "rest")
    if not rest.isEmpty():
        clusters = components(rest, "a", "node")
        members = materialize(clusters.join(classes.select("node", "n"), "node"), "clusters")
        blocks = broadcast_within(materialize(members.groupBy("component").agg(few.alias("blocks")), "blocks"))
        own = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        wanted = paired.select(F.col("component").alias("x"), F.least("block", "other").alias("y"), F.greatest("block", "other").alias("z"), "node", "block")
        more = linked_by(wanted, _block_links(share))
        linked = broadcast_within(materialize(components(links.unionByName(more)), "linked"))

    # Only documents that share their words or are linked need the lookup by digest.
    named = classes.join(linked, "node", "left").filter("copies > 1 OR component IS NOT NULL").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    least = broadcast_within(materialize(named.groupBy("component").agg(F.min("doc_id").alias("own")), "least"))
    lookup = broadcast_within(materialize(named.join(least, "component").select("digest", "own"), "lookup"))
    found = signed.select("doc_id", "tie", "n", "digest").join(lookup, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "tie", F.col("n").alias("n_shingles"), component.alias("component_id"))
