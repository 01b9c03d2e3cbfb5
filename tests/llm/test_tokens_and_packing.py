import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrel.llm import packing, token_shards
from sparrel.llm.token_counts import context_table, length_histogram, quantile, truncated_total
from sparrel.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PAIRS = [(Encoder(p, capacity=3000, chunk=64), Tokenizer.from_file(p)) for p in (BYTE, WORD)]
TEXTS = [
    "", " ", "a", " a  b\n\n c\t", "It's we'LL they'Re 'S x's", "Éèß ŉ İ ſ naïve façade Ως ΑΣ ΑΣ. x", "a <|endoftext|> b<|endoftext|>", "1234 5.6e7 ²³ ½ _a_ __",
    " x  y　z \x1c q \x85 w", "日本語 text — “quoted” …", "é café ́", "😀 a😀b  😀", "tab\there \n new", "a\r\nb \r\n c", "x" * 500,
    "DON'T don't I'm 'm", "a - b -- c --- 'sd", "µ ª º × ÷ ±",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(text):
    for mine, full in PAIRS:
        assert mine.ids(text).tolist() == full.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sS.,1é_É- ́²ŉ<|>x")), max_size=40))
def test_ids_of_odd_texts(text):
    for mine, full in PAIRS:
        assert mine.ids(text).tolist() == full.encode(text, add_special_tokens=False).ids


DOCS = "doc_id long, text string, length int, start int"
ROWS = [(4, "It's a test", 1, 1), (2, None, 1, 1), (3, "", 1, 1), (None, "x", None, 1), (7, "word " * 3000, 1, 1), (2, None, 1, 1), (9, "Ünï " * 50, 1, None)]


def test_histogram(spark):
    full = PAIRS[0][1]
    sizes = [len(full.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in ROWS]
    table = context_table(length_histogram(spark.createDataFrame(ROWS, DOCS), BYTE))
    for r in table.collect():
        big = [s for s in sizes if s >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(r.length), len(big), sum(big))
        assert r.truncated_total == sum(min(s, r.length) for s in sizes)
        assert r.share_up_to == pytest.approx(sum(s <= r.length for s in sizes) / len(sizes))
    for limit in (0, 1, 2, 3, 100, 2999, 3001, 10**6):
        assert truncated_total(table, limit).first()[0] == sum(min(s, limit) for s in sizes)
    assert quantile(table, 0.5).first()[0] == sorted(sizes)[3]
    empty = context_table(length_histogram(spark.createDataFrame([], DOCS), BYTE))
    assert empty.count() == 0 and truncated_total(empty, 5).first()[0] == 0 and quantile(empty, 0.5).first()[0] is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=3000), st.integers(0, 2**32 - 1))
def test_blocks_round_trip(values, base):
    ids = np.array([(v + base) % 2**32 for v in values] * 2, "<u4")
    blocks = token_shards.encode_blocks(ids)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    assert token_shards.decode_blocks(b"".join(blocks), starts).tolist() == ids.tolist()


def test_outliers_are_exceptions():
    ids = np.arange(1024, dtype="<u4") % 16
    ids[5] = 2**31
    assert len(token_shards.encode_blocks(ids)[0]) < 1024 * 4 / 8 + 50


def test_shard_access():
    class Keep(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    class File(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    rng, out = np.random.default_rng(1), Keep()
    writer = token_shards.ShardWriter(out, chunk=2)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 1023, 0, 5000, 1024, 0, 7)]
    for n, ids in enumerate(docs):
        writer.add(n, ids)
    writer.close()
    shard = token_shards.ShardReader(File(out.kept))
    for n in (4, 0, 7, 2):
        assert shard.ids(int(shard.places[n]), int(shard.sizes[n])).tolist() == docs[n].tolist()
    for about in (1, 100, 10**6):
        assert [ids.tolist() for _, ids in shard.documents(about)] == [d.tolist() for d in docs]


def test_shards_round_trip(spark):
    full = PAIRS[0][1]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_shards.round_trip(spark.createDataFrame(ROWS, DOCS), BYTE, 2).collect())
    want, at = [], 0
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_shards.round_trip(spark.createDataFrame([], DOCS), BYTE, 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_bounds_and_fits(lengths):
    sizes = np.array(lengths, np.int64)
    bins, offsets, fill = packing.best_fit_decreasing(sizes, 60)
    assert packing.lower_bound(sizes, 60) <= len(fill)
    for b in range(len(fill)):
        mine = sorted((int(offsets[n]), int(sizes[n])) for n in np.nonzero(bins == b)[0])
        assert all(x + s == y for (x, s), (y, _) in zip(mine, mine[1:])) and mine[0][0] == 0 and sum(s for _, s in mine) == fill[b] <= 60


def test_bounds_are_tight_where_they_can_be():
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 8), 100) == 4
    assert packing.lower_bound(np.array([100, 60, 41, 40]), 100) == 3
    assert packing.lower_bound(np.array([], np.int64), 100) == 0


def test_packing(spark):
    full = PAIRS[1][1]
    docs = spark.createDataFrame(ROWS + [(100 + n, "tok " * (n * 37 % 90), 0, 0) for n in range(300)], DOCS)
    rows = packing.pack(packing.pieces(docs, WORD, 1, 64), 64, per_task=40).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(rows) == packing.pieces(docs, WORD, 1, 64).count()
    assert len(bins) <= 1.08 * sum(r.length for r in rows) / 64
    parts = {r.part: (r.bins, r.bound) for r in rows}
    assert all(0 < bound <= count for count, bound in parts.values())
    assert sum(count for count, _ in parts.values()) >= len(bins) >= max(bound for _, bound in parts.values())
    ids = [*full.encode("word " * 3000, add_special_tokens=False).ids, 1]
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 7) == [
        (n, n * 64, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for n, p in enumerate(ids[k : k + 64] for k in range(0, len(ids), 64))]
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(packing.pieces(empty, WORD, 1, 64), 64).count() == 0
