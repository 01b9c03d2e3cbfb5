"""Vectorised word and shingle hashes over Arrow text, without a Python object per word.

A word of up to 64 bytes is hashed eight bytes at a time, for all words of a chunk at once, by a
chain of 64-bit bijections: no two words of one length up to eight bytes share a hash, and nothing
adds up along a word that structured text could cancel. Longer words go through BLAKE2. A shingle's
hash combines its words' hashes in order. Hashes choose candidates; decisions compare the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHAIN = _rng.integers(1, 2**63, 9, dtype=np.uint64)
_LONGEST = 64

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, about: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, bytes, offsets) of runs of texts of about so many bytes; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + about, "right")) - 1)
        yield first, stop, raw[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        first = stop


def word_places(data: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""First and last bytes of all words and, per text, the place of its first word (one more entry at the end).

    Words are runs outside [\x20\x09-\x0D]; without ``punctuation`` other ASCII characters that are no
    letters or digits end words too.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~(_WHITE if punctuation else _NOT_ALNUM)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.nonzero(starts)[0], np.nonzero(ends)[0]
    return first, last, np.searchsorted(first, offsets)


def hash_words(lower: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of words given by their first and last bytes."""
    size = last - first + 1
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(lower) + 1,), "<u8", padded.data, strides=(1,))
    out = mix(size.astype(np.uint64) ^ _CHAIN[8])
    active, at, left = slice(None), first, size
    for n in range(_LONGEST // 8):
        out[active] = mix(out[active] ^ (eight[at] & _FIRST_BYTES[np.minimum(left, 8)]) ^ _CHAIN[n])
        more = np.nonzero(left > 8)[0]
        if not len(more):
            break
        at, left = at[more] + 8, left[more] - 8
        active = more if isinstance(active, slice) else active[more]
    for n in np.nonzero(size > _LONGEST)[0].tolist():
        out[n] = int.from_bytes(hashlib.blake2b(lower[first[n] : last[n] + 1].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and, per text, the place of its first word (one more entry at the end)."""
    first, last, places = word_places(data, offsets, punctuation)
    return hash_words(_LOWER[data], first, last), places


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by first word."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for n in range(k):
        total += words[n : len(words) - k + 1 + n] * _ORDER[n % 64] + np.uint64(n // 64)
    return mix(total)


@dataclass(slots=True)
class Shingles:
    """A text's distinct shingles: sorted hashes, each with the bytes of ``words`` where it first stands."""

    hashes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    words: bytes

    def agree(self, other: Shingles) -> int:
        """How many shingles both have, compared byte by byte."""
        _, mine, others = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        a, b = self.words, other.words
        places = zip(self.starts[mine].tolist(), self.stops[mine].tolist(), other.starts[others].tolist(), other.stops[others].tolist(), strict=True)
        return sum(a[i:j] == b[k:m] for i, j, k, m in places)


def shingled(texts: pa.Array, k: int) -> Iterator[Shingles]:
    """Per text its shingles of ``k`` words; a text of fewer words has its whole sequence as one. ``words`` are its words, A-Z lower-cased, one space between."""
    for _, _, data, offsets in chunks(texts):
        first, last, places = word_places(data, offsets)
        lower = _LOWER[data]
        hashes = hash_words(lower, first, last)
        runs = windows(hashes, k)
        keep = ~_WHITE[data]
        inner = np.ones(len(first), bool)
        inner[places[1:][places[1:] > places[:-1]] - 1] = False  # the last word of each text
        gaps = last[inner] + 1
        keep[gaps], lower[gaps] = True, 0x20
        place = np.concatenate([[0], np.cumsum(keep)])
        joined, starts, stops = lower[keep], place[first], place[last] + 1
        for n in range(len(offsets) - 1):
            a, b = int(places[n]), int(places[n + 1])
            if a == b:
                yield Shingles(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), b"")
                continue
            base = starts[a]
            words = joined[base : stops[b - 1]].tobytes()
            if b - a >= k:
                found, at = np.unique(runs[a : b - k + 1], return_index=True)
                yield Shingles(found, starts[a + at] - base, stops[a + at + k - 1] - base, words)
            else:
                yield Shingles(windows(hashes[a:b], b - a) ^ np.uint64(b - a), np.zeros(1, np.int64), np.array([len(words)]), words)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    return (s.hashes for s in shingled(texts, k))
