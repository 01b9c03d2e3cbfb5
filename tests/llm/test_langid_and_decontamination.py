import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparrel.llm import decontaminate, langid
from sparrel.llm.queries import op5_language_id

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_forward(word, chance, floor):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = chance.get(word[:n], floor if n == 1 else 0.0)
        if p:
            total += p * brute_forward(word[n:], chance, floor)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁a", "▁", "ba", "aba"]
    rng = np.random.default_rng(1)
    chances = np.vstack([np.full((1, 2), 1e-3), rng.random((len(pieces), 2))])
    lattice = langid.Lattice(pieces)
    words = ["▁abab", "▁b", "▁xab", "▁aaaaaa", "▁abc"]
    for places, table in lattice.groups(words):
        got = langid.forward(table, chances)[:, -1]
        for row, n in enumerate(places):
            for lang in range(2):
                want = brute_forward(words[n], {p: chances[k + 1, lang] for k, p in enumerate(pieces)}, 1e-3)
                assert got[row, lang] == pytest.approx(want)


def brute_counts(word, chance, floor, pieces):
    ways = []

    def walk(rest, used, p):
        if not rest:
            ways.append((used, p))
        for n in range(1, len(rest) + 1):
            q = chance.get(rest[:n], floor if n == 1 else 0.0)
            if q:
                walk(rest[n:], [*used, rest[:n]], p * q)

    walk(word, [], 1.0)
    total = sum(p for _, p in ways)
    return [sum(p / total * used.count(x) for used, p in ways) for x in pieces]


def test_expected_counts():
    pieces = ["a", "b", "ab", "▁a", "▁", "ba"]
    chances = np.vstack([[[1e-3]], np.random.default_rng(2).random((len(pieces), 1))])
    lattice = langid.Lattice(pieces)
    ((_, table),) = lattice.groups(["▁abab"])
    got = langid.expected_counts(table, np.ones((1, 1)), chances)[1:, 0]
    assert got == pytest.approx(brute_counts("▁abab", {p: chances[k + 1, 0] for k, p in enumerate(pieces)}, 1e-3, pieces))


@pytest.mark.parametrize("slab", [7, 1 << 15])
def test_long_words_are_summed_whole(monkeypatch, slab):
    pieces = ["a", "b", "ab", "▁a", "▁", "ba", "aba", "abbabb"]
    chances = np.vstack([np.full((1, 2), 1e-6), np.random.default_rng(1).random((len(pieces), 2))])
    lattice = langid.Lattice(pieces)
    monkeypatch.setattr(langid, "_SLAB", slab)
    for word in ("▁abab", "▁", "a", "▁abbabbxxab" * 3):
        ((_, table),) = lattice.groups([word])
        assert langid.long_word(word, lattice, chances) == pytest.approx(np.log(langid.forward(table, chances)[0, -1]))
    # a run of unknown letters: each costs the floor
    assert langid.long_word("é" * 5000, lattice, chances) == pytest.approx(5000 * np.log(1e-6))


def test_letters():
    assert langid.marked_words("½ ² Ⅷ ① 12 a1b don't É") == ["▁a", "▁b", "▁don", "▁t", "▁é"]
    assert max(map(len, langid.vocabulary(PIECES))) > 8


def test_many_languages(spark):
    """Each of 300 languages is learned; a row repeated often is read once."""
    rows = [(n, f"{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + n % 26)} " * 30, f"l{n:03}") for n in range(300)] + [(1000, "qq qq", "often")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.labelled_sample(docs, 150, 1000)) == 301
    assert len({lang for lang, _ in langid.labelled_sample(docs, 150, 20)}) == 20
    got = langid.identify(docs, docs, PIECES).filter("doc_id < 1000").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 295


def brute_predictions(samples, texts, pieces, rounds=3, floor=1e-6):
    """The whole model in plain Python: expectation-maximisation, forward sums, shares."""
    languages = sorted({lang for lang, _ in samples})
    words = {lang: [w for x, t in samples if x == lang for w in langid.marked_words(t)] for lang in languages}
    chance = {lang: dict.fromkeys(pieces, 1 / (len(pieces) + 1)) for lang in languages}
    unknown = 1 / (len(pieces) + 1)

    def sums(word, p):
        out = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            out[j] = sum(out[i] * p.get(word[i:j], unknown if j - i == 1 else 0.0) for i in range(j))
        return out

    for _ in range(rounds):
        for lang in languages:
            p, total, other = chance[lang], dict.fromkeys(pieces, 0.01), 0.01
            for w in words[lang]:
                left, right = sums(w, p), sums(w[::-1], {k[::-1]: v for k, v in p.items()})[::-1]
                for i in range(len(w)):
                    for j in range(i + 1, len(w) + 1):
                        q = p.get(w[i:j], unknown if j - i == 1 else 0.0)
                        use = left[i] * q * right[j] / left[-1]
                        if w[i:j] in p:
                            total[w[i:j]] += use
                        else:
                            other += use
            whole = sum(total.values()) + other
            chance[lang] = {k: v / whole for k, v in total.items()}
        unknown = floor
    out = []
    for text in texts:
        found = langid.marked_words(text or "")
        if not found:
            out.append(("und", 0.0))
            continue
        logs = [sum(math.log(sums(w, chance[lang])[-1]) for w in found) for lang in languages]
        best = max(logs)
        out.append((languages[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)))
    return out


def test_whole_query_against_brute_force(spark, tmp_path, monkeypatch):
    from sparrel.llm import queries

    rng = random.Random(2)
    pieces = ["▁", "a", "b", "c", "ab", "▁ab", "bc", "▁c", "abc", "▁abcabcab", "ca"]
    odds = {"x": "aab", "y": "bbc", "z": "cca"}
    rows = [(n, " ".join("".join(rng.choice(odds[k]) for _ in range(rng.randrange(1, 9))) for _ in range(6)), k, "s", 1) for n in range(60) for k in "xyz"[n % 3]]
    rows += [(100, None, "x", "s", 0), (101, "½ 12", None, "s", 0), (102, "d" * 30 + " abc", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(langid, "vocabulary", lambda _: sorted(pieces))
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op5_language_id(spark, str(tmp_path)).collect()}
    held = {n: zlib.crc32(str(n).encode()) % 4 == 2 for n, *_ in rows}
    want = brute_predictions([(lang, t) for n, t, lang, *_ in rows if lang and t and not held[n]], [t for _, t, *_ in rows], pieces)
    for (n, *_), (lang, score) in zip(rows, want, strict=True):
        assert got[n][:2] == (held[n], lang) and got[n][2] == pytest.approx(score)


def test_scorer_memory_does_not_change_results():
    pieces = langid.vocabulary(PIECES)
    samples = [("en", "the cat and the dog were there"), ("de", "der hund und die katze waren da")]
    languages, chances = langid.fit(samples, pieces)
    texts = ["the dog", "don't stop-it", None, "", "12 !?", "die katze " * 50, "x" * 200, "ÄÖ ß", "日本"]
    small, large = (langid.Scorer(pieces, languages, chances, capacity=n) for n in (500, 1 << 20))
    want = large.totals(texts)
    assert np.vstack([small.totals([t]) for t in texts]) == pytest.approx(want)
    assert large.predict(texts)[0][:6] == ["en", large.predict(["don't stop-it"])[0][0], "und", "und", "und", "de"]
    assert (large.predict(texts)[1][[2, 3, 4]] == 0).all()


DOCS = "doc_id long, text string, lang string, score string, n int"


def test_identify_defined_cases(spark):
    rows = [(n, "the cat and the dog" if n % 2 else "der hund und die katze", "en" if n % 2 else "de", "x", n) for n in range(20)]
    odd = [(100, None, "en", "", 1), (101, "", None, "", 1), (None, "the dog", None, None, 2), (102, "123 --", "de", "", 3), (103, "the " * 100_000, None, "", 4), (103, "the dog", None, "", 4)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = langid.identify(docs, docs, PIECES)
    assert got.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score"] and got.count() == 26
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got.collect()}
    assert found[100, None] == found[101, ""] == found[102, "123 --"] == ("und", 0.0)
    assert found[None, "the dog"][0] == found[103, "the dog"][0] == found[103, "the " * 100_000][0] == "en"
    assert all(0 <= s <= 1 for _, s in found.values())
    none = langid.identify(docs, docs.filter("false"), PIECES)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), docs, PIECES).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op5_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    rows = got.filter("held_out").select("doc_id", F.expr("lang = lang_pred").alias("right")).collect()
    assert sum(r.right for r in rows) >= 0.99 * len(rows) > 0
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def brute_overlaps(words, item):
    """Whether some aligned window of the item's span has few enough differences, by trying all."""
    span = next((s for s in decontaminate.SPANS if len(item) >= s), None)
    if span is None:
        return False
    return any(
        sum(words[p + n] == item[q + n] for n in range(span)) >= span - span // 6
        for p in range(len(words) - span + 1) for q in range(len(item) - span + 1)
    )


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(50)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (2, 3, 4, 6, 8, 11, 12, 13, 20, 40)]
    docs, want = [], set()
    for d in range(250):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        item = rng.choice(items)
        piece = item[rng.randrange(len(item)) :] if rng.random() < 0.3 else list(item)
        for _ in range(rng.randrange(0, 5)):
            piece[rng.randrange(len(piece))] = rng.choice(vocabulary)
        at = rng.randrange(len(words) + 1)
        words[at:at] = piece
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words).upper(), 0))
        want |= {(d, i) for i, x in enumerate(items) if brute_overlaps(words, x)}
    frame = spark.createDataFrame([*docs, (900, None, 1), (901, "", 1), (902, "x" * 500_000, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    got = decontaminate.overlaps(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        words, item = docs[r.doc_id][1].lower().replace(",", " ").split(), items[r.item_id]
        pairs = zip(words[r.doc_start : r.doc_start + r.length], item[r.item_start : r.item_start + r.length], strict=True)
        assert sum(a == b for a, b in pairs) == r.matched
    assert decontaminate.overlaps(frame.limit(0), bench).count() == 0
    assert decontaminate.overlaps(frame, bench.limit(0)).count() == 0
    assert math.comb(4, 2) == len(decontaminate.MASKS)


def test_repetitive_and_repeated_texts(spark):
    """Ten thousand words against an item of two thousand, both of two words: hits fold to shifts."""
    long = "tick tock " * 5000
    schema = "doc_id long, text string, n int, tie string"
    docs = spark.createDataFrame([(1, long, 1, ""), (1, long, 2, ""), (None, "tick tock " * 6, 3, None), (2, "tick " * 40, 4, "")], schema)
    bench = spark.createDataFrame([(7, "tick tock " * 1000), (7, "tick tock " * 1000), (8, "tock")], "item_id long, text string")
    got = sorted(decontaminate.overlaps(docs, bench).collect(), key=repr)
    assert [(r.doc_id, r.item_id, r.length, r.matched) for r in got if r.item_id == 7] == [(1, 7, 2000, 2000)] * 2 + [(None, 7, 12, 12)]
    assert [r.doc_id for r in got if r.item_id == 8] == [1, 1, None]
    assert decontaminate.contaminated(docs, bench).count() == 2


def test_hashes_do_not_decide():
    bits = decontaminate.BitTable(16, np.arange(1 << 16))
    doc, item = decontaminate.Words("a b c d e f g h"), decontaminate.Words("a b c d e f g h")
    assert decontaminate.best_overlap(doc, item, bits) == (0, 0, 8, 8)
    item.lower = item.lower.copy()
    item.lower[:] = 120
    assert decontaminate.best_overlap(doc, item, bits) is None


def test_stretches_cut_no_word(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aбcß", k=rng.randint(1, 9))) for _ in range(200)), "a" * 300, "", " ", "one\ntwo " * 50, None]
    pieces, languages = ["▁a", "a", "b", "▁"], ["x", "y"]
    scorer = langid.Scorer(pieces, languages, np.random.default_rng(1).random((5, 2)))
    want = scorer.totals(texts)
    monkeypatch.setattr(langid, "_STRETCH", 20)
    for text in texts[:-1]:
        assert "".join(langid.stretches(text)) == text
    assert langid.Scorer(pieces, languages, scorer.chances, capacity=1000).totals(texts) == pytest.approx(want)
