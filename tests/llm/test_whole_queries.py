"""Registered queries that SQL cannot express, against brute force over whole tables."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_langid_and_decontamination import brute_overlaps
from test_near_dedup import brute_components
from test_pipeline import tokens
from test_suffix_dedup import brute
from tokenizers import Tokenizer

from sparrel.llm.queries import QUERIES

FOLDER = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


def encoded(name, rows, end):
    full = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, [*e.ids, *end]) for (i, _), e in zip(rows, full.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(spark, rows):
    sizes = [len(ids) for _, ids in encoded("byte_bpe_50k.json", rows, [])]
    got = QUERIES["op1_token_counts"](spark, FOLDER).collect()
    assert sorted((r.length, r.n_docs) for r in got) == sorted((s, sizes.count(s)) for s in set(sizes))
    assert all(r.truncated_total == sum(min(s, r.length) for s in sizes) and r.docs_at_least == sum(s >= r.length for s in sizes) for r in got)


def test_packing(spark, rows):
    want = []
    for i, ids in encoded("word_bpe_49k.json", rows, [1]):
        want += [(i, n, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for n, at in enumerate(range(0, len(ids), 4096))]
    got = QUERIES["op4_best_fit_packing"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1 + 1.02 * sum(w[3] for w in want) / 4096


def test_decontamination(spark, rows):
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, FOLDER).collect()}
    seen = 0
    for i, text in rows:
        words = tokens(text or "")
        if len(words) > 400:
            # long texts: only items with two words in a row in common are tried
            pairs = set(zip(words, words[1:]))
            some = [(k, x) for k, x in items if sum(p in pairs for p in zip(x, x[1:])) >= 4]
            some = [(k, x) for k, x in some if any(tuple(x[n : n + 2]) in pairs and tuple(x[n + 1 : n + 3]) in pairs for n in range(len(x) - 2))][:6]
        else:
            some = items
        for k, x in some:
            assert brute_overlaps(words, x) == ((i, k) in got)
            seen += (i, k) in got
    assert seen


def test_suffix_dedup(spark, rows):
    got = QUERIES["op7_suffix_dedup"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == brute(rows, 200)


def test_token_shards(spark, rows):
    at, want = 0, []
    for i, ids in encoded("byte_bpe_50k.json", rows, [2]):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op9_token_shards"](spark, FOLDER).collect())) == want


def test_near_dedup(spark, rows):
    got = QUERIES["op10_minhash_near_dedup"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
