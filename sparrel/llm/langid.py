"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A word (a run of letters, lower-cased, behind a word mark) may be cut into vocabulary pieces in many
ways. Per language each piece has a probability; the probability of a word is the sum over all its
segmentations, by a forward pass over character positions, and a text's is the product over its
words. Piece probabilities are fitted by expectation-maximisation with forward and backward sums on
a bounded sample of labelled documents; single characters outside the vocabulary share a small
floor. Sums over long words are rescaled as they go, so words of any length are scored whole.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without labelled rows
every text is ``und``; rows without a language are not learned from; repeated rows are predicted
alike; other columns are kept, except those named like a result column.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.llm.common import worker_resource
from sparrel.llm.shingles import chunks

MARK = "▁"
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words up to this length need no rescaling: their sums stay far above the smallest float.
_SHORT = 40
_SLAB = 1 << 15
#: Words are looked up in stretches of about so many characters.
_STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPREAD = 0xD1342543DE82EF95


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentence-piece model that can occur in a marked word, lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(n).lower() for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_byte(n) or model.is_unknown(n))}
    return sorted(p for p in pieces if ((body := p.removeprefix(MARK)) == "" or _LETTERS.fullmatch(body)))


def marked_words(unit: str) -> list[str]:
    """The words of a stretch of text, each behind the mark."""
    return [MARK + word for word in _LETTERS.findall(unit.lower())]


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of about ``_STRETCH`` characters that end before a space, so that no word is cut."""
    at = 0
    while len(text) - at > _STRETCH and (to := text.find(" ", at + _STRETCH)) >= 0:
        yield text[at:to]
        at = to
    yield text[at:] if at else text


class Lattice:
    """Piece numbers of all substrings of words, grouped by word length. Number 0 is the floor for unknown characters.

    Pieces lie in an open-addressing table by a 64-bit hash of their characters, looked up for all
    substrings of one length at once.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces) + 1
        self.bits = max(10, (4 * self.size).bit_length())
        hashes = [0] * len(pieces)
        for n, piece in enumerate(pieces):
            for c in piece:
                hashes[n] = (hashes[n] * _BASE + ord(c) + 1) & (2**64 - 1)
        if len({*hashes, 0}) != len(pieces) + 1:
            raise ValueError("two pieces have one hash")
        self.keys, self.numbers, self.probes = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -1, np.int32), 1
        for n, h in enumerate(hashes, 1):
            at = (h * _SPREAD & (2**64 - 1)) >> (64 - self.bits)
            probe = next(k for k in range(64) if not self.keys[at + k])
            self.keys[at + probe], self.numbers[at + probe] = h, n
            self.probes = max(self.probes, probe + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes * np.uint64(_SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.numbers[at], -1)
        for probe in range(1, self.probes):
            out = np.where(self.keys[at + probe] == hashes, self.numbers[at + probe], out)
        return out

    def groups(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(places of words, numbers[word, start, length-1]); -1 where no piece fits."""
        by_length = defaultdict(list)
        for n, w in enumerate(words):
            by_length[len(w)].append(n)
        for length, places in by_length.items():
            reach = min(self.longest, length)
            text = "".join([words[n] for n in places]).encode("utf-32-le")
            codes = np.frombuffer(text, "<u4").reshape(len(places), length).astype(np.uint64) + np.uint64(1)
            table = np.full((len(places), length, reach), -1, np.int32)
            hashes = np.zeros_like(codes)
            for n in range(reach):
                hashes = hashes[:, : length - n] * np.uint64(_BASE) + codes[:, n:]
                table[:, : length - n, n] = self.find(hashes)
            single = table[:, :, 0]
            single[single < 0] = 0
            yield places, table


def forward(table: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Forward sums, shape (word, position, language), of words of one length up to ``_SHORT``."""
    count, length, reach = table.shape
    padded = np.vstack([chances, np.zeros((1, chances.shape[1]))])  # the last row serves number -1
    alpha = np.zeros((count, length + 1, chances.shape[1]))
    alpha[:, 0] = 1
    for i in range(length):
        for j in range(i + 1, min(length, i + reach) + 1):
            alpha[:, j] += alpha[:, i] * padded.take(table[:, i, j - i - 1], axis=0, mode="wrap")
    return alpha


def expected_counts(table: np.ndarray, weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language, for words weighted per language."""
    count, length, reach = table.shape
    padded = np.vstack([chances, np.zeros((1, chances.shape[1]))])
    alpha = forward(table, chances)
    beta = np.zeros_like(alpha)
    beta[:, length] = 1
    for i in range(length - 1, -1, -1):
        for j in range(i + 1, min(length, i + reach) + 1):
            beta[:, i] += padded[table[:, i, j - i - 1]] * beta[:, j]
    total = np.zeros_like(padded)
    scale = weights / np.maximum(alpha[:, length], 1e-300)
    for i in range(length):
        for j in range(i + 1, min(length, i + reach) + 1):
            ids = table[:, i, j - i - 1]
            np.add.at(total, ids, alpha[:, i] * padded[ids] * beta[:, j] * scale)
    return total[:-1]


def long_word(word: str, lattice: Lattice, chances: np.ndarray) -> np.ndarray:
    """Log of the forward sum of one word of any length, per language: a slab of starts at a time, rescaled whenever sums get small."""
    padded = np.vstack([chances, np.zeros((1, chances.shape[1]))])
    logs, reach = np.zeros(chances.shape[1]), lattice.longest
    open_sums = np.zeros((reach, chances.shape[1]))
    open_sums[0] = 1
    for first in range(0, len(word), _SLAB):
        ((_, table),) = lattice.groups([word[first : first + _SLAB + reach - 1]])
        steps, count = table.shape[2], min(_SLAB, len(word) - first)
        sums = np.vstack([open_sums, np.zeros((count, chances.shape[1]))])
        for n in range(count):
            if sums[n].min() < 1e-100:
                factor = np.where(sums[n] < 1e-100, 1e100, 1.0)
                sums[n : n + reach] *= factor
                logs -= np.log(factor)
            sums[n + 1 : n + 1 + steps] += sums[n] * padded[table[0, n]][: len(sums) - n - 1]
        open_sums = sums[count : count + reach]
    return np.log(open_sums[0]) + logs


def fit(samples: list[tuple[str, str]], pieces: list[str], rounds: int = 3, floor: float = 1e-6) -> tuple[list[str], np.ndarray]:
    """Languages and their piece chances (piece, language) from the words of up to ``_SHORT`` characters of (language, text) samples."""
    languages = sorted({lang for lang, _ in samples})
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in samples:
        counts[lang].update(w for unit in text.split() for w in marked_words(unit) if len(w) <= _SHORT)
    words = sorted(set().union(*counts.values())) if counts else []
    weights = np.array([[counts[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
    lattice = Lattice(pieces)
    chances = np.full((lattice.size, len(languages)), 1 / lattice.size)
    groups = list(lattice.groups(words))
    for _ in range(rounds):
        total = np.zeros_like(chances)
        for places, table in groups:
            total += expected_counts(table, weights[places], chances)
        total += 0.01  # no piece becomes impossible in a language
        chances = total / total.sum(axis=0)
        chances[0] = floor
    return languages, chances


class Scorer:
    """Log chances of texts per language, with a memory of word results that is bounded in bytes; a stretch of text may exceed it until it ends."""

    def __init__(self, pieces: list[str], languages: list[str], chances: np.ndarray, capacity: int = 40 << 20) -> None:
        self.lattice, self.languages, self.chances = Lattice(pieces), languages, chances
        self.capacity = capacity // (16 * (len(languages) + 1) + 200)
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1 << 10, len(languages)))

    def _keep(self, words: list[str]) -> None:
        """Forget all words but these."""
        rows = [self.words[w] for w in words]
        self.words = {w: n for n, w in enumerate(words)}
        self.scores = np.concatenate([self.scores[rows], np.zeros((1 << 10, len(self.languages)))])

    def _learn(self, words: list[str]) -> None:
        start = len(self.words)
        self.words.update(zip(words, range(start, start + len(words)), strict=True))
        while len(self.scores) < len(self.words):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        marked = [MARK + w for w in words]
        short = [n for n, w in enumerate(marked) if len(w) <= _SHORT]
        for first in range(0, len(short), 1 << 14):
            some = np.array(short[first : first + (1 << 14)])
            for places, table in self.lattice.groups([marked[n] for n in some]):
                at = start + some[places]
                width = max(1, (1 << 15) // max(1, len(self.languages)))
                for k in range(0, len(places), width):
                    self.scores[at[k : k + width]] = np.log(forward(table[k : k + width], self.chances)[:, -1])
        for n, w in enumerate(marked):
            if len(w) > _SHORT:
                self.scores[start + n] = long_word(w, self.lattice, self.chances)

    def _add(self, out: np.ndarray, texts: list[int], words: list[list[str]]) -> None:
        """Add the results of words to the totals of their texts."""
        wanted = set().union(*words)
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > self.capacity:
            self._keep(list(wanted.difference(new)))
        self._learn(list(new))
        width = max(1, (1 << 21) // (len(self.languages) + 1))
        for n, found in zip(texts, words, strict=True):
            rows = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
            out[n, -1] += len(found)
            for k in range(0, len(rows), width):
                out[n, :-1] += self.scores[rows[k : k + width]].sum(axis=0)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Sums over all words of each text, and in the last column their number, shape (text, language + 1)."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        places, words, size = [], [], 0
        for n, text in enumerate(texts):
            for part in stretches(text or ""):
                places.append(n)
                words.append(_LETTERS.findall(part.lower()))
                size += len(part)
                if size >= _STRETCH:
                    self._add(out, places, words)
                    places, words, size = [], [], 0
        self._add(out, places, words)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its share among the learned languages, taken as equally likely beforehand."""
        totals = self.totals(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs = totals[:, :-1]
        best = logs.argmax(axis=1)
        share = 1 / np.exp(np.minimum(logs - logs.max(axis=1, keepdims=True), 0)).sum(axis=1)
        known = totals[:, -1] > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def _scorer(name: str, model) -> Scorer:
    """The worker's scorer of a broadcast model, kept from task to task while no other resource is asked for."""
    return worker_resource(("scorer", name), lambda: Scorer(*model.value))


def labelled_sample(docs: DataFrame, per_language: int, languages: int, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """About ``per_language`` whole documents of each of the ``languages`` most frequent languages, chosen by hash of the text, equal texts once: the only rows the fit reads."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("different"))
    shares = {r.lang: min(1.0, per_language / max(1, r.different)) for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not shares:
        return []
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[x for lang, s in shares.items() for x in (F.lit(lang), F.lit(s))])
    return [(r.lang, r.text) for r in rows.filter(place < F.try_element_at(limit, F.col("lang"))).select("lang", "text").distinct().orderBy("lang", "text").collect()]


def identify(
    docs: DataFrame, training: DataFrame, vocabulary_path: str, per_language: int = 150, languages: int = 1000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with lang_pred and score. Learns from text and language of ``training`` only.

    ``per_language``, ``languages``: the fit reads so many documents per language on average, and learns so many
    languages at most, the most frequent ones: its sample is bounded by both.
    """
    pieces = vocabulary(vocabulary_path)
    learned, chances = fit(labelled_sample(training, per_language, languages, text_col, lang_col), pieces)
    model = docs.sparkSession.sparkContext.broadcast((pieces, learned, chances))
    name = uuid.uuid4().hex
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    column = base.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, model)
        for batch in batches:
            langs, scores = [], []
            for first, stop, _, _ in chunks(batch.column(column), 2 << 20):
                found, share = scorer.predict(batch.column(column).slice(first, stop - first).to_pylist())
                langs += found
                scores.append(share)
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
