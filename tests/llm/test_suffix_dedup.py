import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrel.llm.suffix_sort import common_prefixes, suffix_array


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    got = suffix_array(text)
    assert got == sorted(range(len(text)), key=lambda s: text[s:])
    for r, n in enumerate(common_prefixes(text, got)):
        a, b = (text[got[r - 1] :], text[got[r] :]) if r else ([], [])
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("text", ["a" * 300, "ab" * 200, "abaababaabaab" * 20, "mississippi", "zyx" * 50 + "a", ""])
def test_suffix_array_of_repetitive_texts(text):
    raw = text.encode()
    assert suffix_array(raw) == sorted(range(len(raw)), key=lambda s: raw[s:])


def brute(rows, width):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[n : n + width] for _, raw in raws for n in range(len(raw) - width + 1))
    out = []
    for i, raw in raws:
        gone = [False] * len(raw)
        for n in range(len(raw) - width + 1):
            if seen[raw[n : n + width]] > 1:
                gone[n : n + width] = [True] * width
        runs = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i if i is not None else -1, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma ", "d", "e\n", "zeta,", "η"]
    passages = [" ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(rng.choice([20, 40, 90]))) for _ in range(12)]
    rows = []
    for n in range(docs):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            p = p[a : a + rng.randrange(len(p))]
            if rng.random() < 0.5 and p:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, "".join(rng.choice("xyzé ") for _ in range(rng.randrange(60)))]
        rows.append((n, "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "width", "bucket"), [(1, 200, 20_000), (2, 60, 20_000), (3, 60, 2), (4, 45, 20_000)])
def test_against_brute_force(spark, seed, width, bucket):
    from sparrel.llm.suffix_dedup import digests, drop_repeats

    rows = corpus(seed) + [(500, None), (501, ""), (502, "q" * 5000), (503, "ab" * 3000), (None, "unique " + "n" * 30), (504, corpus(seed)[3][1]), (504, corpus(seed)[3][1]), (None, corpus(seed)[5][1])]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, start int, gram string")
    got = digests(drop_repeats(docs, width, bucket)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows, width)


def test_structured_and_long_texts(spark, monkeypatch):
    """Strings that any sum of powers modulo 2**64 takes for one are told apart, and stretches of a long text meet."""
    from sparrel.llm import suffix_dedup

    x = "a"
    while len(x) < 512:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    rng = random.Random(9)
    noise = ["".join(rng.choice("cdefgh ") for _ in range(40)) for _ in range(6)]
    rows = [(1, noise[0] + x + noise[1]), (2, noise[2] + y + noise[3]), (3, noise[4] + x[100:400]), (4, "".join(noise) * 6 + y[7:300])]
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 300)
    monkeypatch.setattr(suffix_dedup._anchors, "__defaults__", (300,))
    got = suffix_dedup.digests(suffix_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got)) == brute(rows, 200)


def test_empty_table(spark):
    from sparrel.llm.suffix_dedup import drop_repeats

    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
