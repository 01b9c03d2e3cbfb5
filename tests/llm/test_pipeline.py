import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from test_langid_and_decontamination import brute_overlaps  # noqa: E402
from test_near_dedup import brute_components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def test_run_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [tokens(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = sorted((i, t) for i, t in rows if any(c.isalpha() for c in t or ""))
    first = {}
    for i, t in rows:
        first.setdefault(" ".join(t.replace("\t", " ").split(" ")), (i, t))
    near = brute_components(sorted(first.values()), 5, 80, 100)
    keep = {i for i, _, c in near if i == c}
    kept = [(i, t) for i, t in first.values() if i in keep]
    # only texts that share four words in a row with an item are tried in full
    runs = {tuple(x[n : n + 4]) for x in items for n in range(len(x) - 3)}
    clean = []
    for i, t in kept:
        words = tokens(t)
        some = [n for n in range(len(words) - 3) if tuple(words[n : n + 4]) in runs]
        parts = [words[max(0, n - 80) : n + 84] for n in some]
        if not any(brute_overlaps(p, x) for p in parts[:400] for x in items):
            clean.append((i, t))
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(full.encode(t, add_special_tokens=False).ids) + 1) for i, t in clean)
    got = {}
    fill = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sorted(got.items()) == want
    assert max(fill.values()) <= 4096


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_odd_tables(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, node string"
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, None, None), (None, "the cat and the dog", None, None, 3, 1, ""), (3, "the cat and the dog", "en", "s", 3, 1, ""),
            (3, "the cat and the dog", "en", "s", 3, 1, ""), (4, "word " * 50_000, "en", "s", 9, 2, "")]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        out = stage(spark, frame, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() <= max(len(rows), 1000)
