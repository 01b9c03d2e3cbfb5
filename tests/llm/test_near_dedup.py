import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparrel.llm import near_dedup, shingles
from sparrel.llm.components import components


def brute_sets(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[n : n + k]) for n in range(max(1, len(words) - k + 1)))


def brute_components(rows, k, part, whole):
    sets = [(i, brute_sets(t, k)) for i, t in rows]
    best = {i: i for i, _ in rows}
    changed = True
    linked = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if x and y and whole * len(x & y) >= part * len(x | y)]
    while changed:
        changed = False
        for a, b in linked:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return sorted((i, len(s), best[i]) for i, s in sets)


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdeéß')}{n}" for n in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 30, 200, 900]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((" \t" if rng.random() < 0.3 else " ").join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets(k):
    texts = [t for _, t in corpus(1)] + ["", None, " \n ", "a", "A b", "x\x0by", "\xa0 z", "ab a b", "a ba b"]
    got = list(shingles.shingle_sets(pa.array(texts), k))
    want = [brute_sets(t, k) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    names = {}
    for g, w in zip(got, want, strict=True):
        assert names.setdefault(w, g.tobytes()) == g.tobytes()
    assert len(set(names.values())) == len(names)
    for size in (1, 50, 10**6):
        pieces = [b for f, s, d, o in shingles.chunks(pa.array(texts)[3:], size) for b in np.diff(o).tolist()]
        assert pieces == [len((t or "").encode()) for t in texts[3:]]


@pytest.mark.parametrize(("seed", "k", "part", "whole"), [(2, 3, 85, 100), (3, 5, 80, 100)])
def test_against_brute_force(spark, seed, k, part, whole):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE "), (1004, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, node string, tie int")
    for block, block_docs in ((400_000, 1500), (500, 3)):
        got = near_dedup.near_duplicates(docs, k, (part, whole), block=block, block_docs=block_docs)
        assert sorted(map(tuple, got.drop("tie").collect())) == brute_components(rows, k, part, whole)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (2, "a b c d"), (None, "a b c d"), (5, "q r s t"), (3, "q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id or 0) for r in near_dedup.near_duplicates(docs, 3, (85, 100)).collect())
    assert got == [(0, 0), (2, 2), (3, 2), (3, 2), (3, 3), (5, 3)]
    text = " ".join(f"w{n}" for n in range(200))
    twice = spark.createDataFrame([(5, text), (3, text.replace("w7 ", "v7 ")), (5, "some thing else altogether")] + [(9, text)] * 50, "doc_id long, text string")
    assert sorted({(r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(twice, 3, (85, 100)).collect()}) == [(3, 3, 198), (5, 3, 198), (5, 5, 2), (9, 3, 198)]
    assert near_dedup.near_duplicates(docs.limit(0), 3, (85, 100)).count() == 0


@pytest.mark.parametrize("part", [85, 80])
def test_recall_at_the_threshold(part):
    """Random pairs right at the threshold share a bucket."""
    rng, bands, rows = np.random.default_rng(5), *near_dedup._shape((part, 100))
    for size in (12, 60, 1000):
        missed = 0
        for _ in range(300):
            own = size * (100 - part) // (100 + part)
            base = rng.integers(0, 2**63, size - own, dtype=np.uint64) * np.uint64(2)
            pair = [np.unique(np.concatenate([base, rng.integers(0, 2**63, own, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2)]
            a, b = near_dedup.signature(pair, bands * rows).reshape(2, bands, rows)
            missed += not (a == b).all(axis=1).any()
        assert missed == 0


def test_blocks_find_links_across_sides():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.97], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(40)]
    side = np.array([0, 1] * 20)

    def shingles_of(s):
        ends = np.arange(1, len(s) + 1) * 8
        return shingles.Shingles(s, ends - 8, ends, s.tobytes())

    links = near_dedup.spanning_links(list(range(40)), [shingles_of(s) for s in sets], side, (85, 100))
    truth = {(x, y) for x in range(40) for y in range(x + 1, 40) if side[x] != side[y] and 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))}
    assert {tuple(sorted(e)) for e in links} <= truth and len(links) <= 39 and truth


def test_structured_words_are_not_mixed_up(spark):
    """Two different words that any sum of powers modulo 2**64 takes for one, and words near the hashed length."""
    x = "a"
    while len(x) < 256:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    words = [x, y, x[:64], y[:64], x[:65], y[:65], x[:8], y[:8], x[:9], x[:63]]
    rows = [(n, f"{w} one two") for n, w in enumerate(words)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(n, n) for n in range(len(words))]


def test_links_compare_words_behind_hashes():
    one = shingles.Shingles(np.arange(10, dtype=np.uint64), np.arange(10), np.arange(1, 11), b"abcdefghij")
    assert near_dedup.similar(one, one, (85, 100))
    assert not near_dedup.similar(one, shingles.Shingles(one.hashes, one.starts, one.stops, b"abcdefghxy"), (85, 100))


def test_pairs_that_no_star_holds(spark):
    """A bucket's centre may be like none of its other documents; they are still linked with each other."""
    rng = random.Random(11)
    base = [f"w{n}" for n in range(120)]
    rows = []
    for n in range(60):
        words = list(base)
        for at in rng.sample(range(120), 8 if n else 0):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    rows += [(100 + n, t.replace("w5 ", "q5 ")) for n, (_, t) in enumerate(rows[20:40])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (80, 100), block_docs=7)
    assert sorted(map(tuple, got.drop("tie").collect())) == brute_components(rows, 3, 80, 100)


def test_components(spark):
    rng = random.Random(3)
    edges = [(n, n + 1) for n in range(60)] + [(100, 100 + n) for n in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(500, 500)]
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == low and got.count() == len(low)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
