"""Token ids of whole texts from a tokenizer file, without Python work per word.

Byte-pair models work inside the pieces of a pre-tokenizer. For the two pre-tokenizer shapes known
here the pieces of Latin text follow from the classes of neighbouring bytes, so a chunk of text is
cut by array operations, its pieces are numbered by a dictionary, and each distinct piece meets the
model once. A space between two plain characters always starts a new piece; stretches between such
spaces that hold anything unusual are one entry each and go through the library's full encoding, as
do tokenizers of any other shape. Long texts are cut at such spaces too, so memory follows the
chunk and the result, not the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sparrel.llm.common import worker_resource

_PLAIN = re.compile("[\t\n\r -~¡-©«¬®-±´¶-¸»¿-įĲ-ňŊ-ž–—‘-”…€]*")
_CONTRACTION = r"'(?:[stmd]|re|ve|ll)"
_SPACED_PIECES = re.compile(_CONTRACTION + r"| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BARE_PIECES = re.compile(_CONTRACTION + r"|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# The regular expression of the tokenizer file whose pieces _BARE_PIECES finds in lower-cased plain text.
_BARE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _WHITE, _LETTER, _DIGIT, _OTHER, _HARD, _LEAD, _EDGE = range(8)


def _kinds() -> np.ndarray:
    """The class of each byte. Two-byte letters of the Latin blocks start with C3 to C5."""
    kinds = np.full(256, _HARD, np.uint8)
    for b in range(32, 127):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER
    kinds[32], kinds[[9, 10, 13]], kinds[[0xC3, 0xC4, 0xC5]] = _SPACE, _WHITE, _LEAD
    return kinds


_KINDS = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Signs in those blocks that are no letters, or letters whose lower case is longer: × ÷ İ ı ŉ ſ.
_ODD_PAIRS = np.array([int.from_bytes(c.encode(), "big") for c in "×÷İıŉſ"], np.uint16)
_CHUNK = 1 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level models write each byte as a printable letter: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """``encode`` equals the library's ``encode(text, add_special_tokens=False).ids``, null as the empty text.

    Remembers the ids of pieces within ``capacity`` bytes; a chunk may exceed them until it ends.
    """

    def __init__(self, path: str, capacity: int = 48 << 20, chunk: int = _CHUNK) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.capacity, self.chunk = capacity, chunk
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.shape = self._shape(spec)
        self.letters = _byte_letters()
        self._forget()

    @staticmethod
    def _shape(spec: dict) -> str:
        normal, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["post_processor"] or spec["model"].get("ignore_merges"):
            return "other"
        if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "spaced"
        steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            split = parts[0]
            if split["pattern"] == {"Regex": _BARE_PATTERN} and split["behavior"] == "Removed" and split["invert"] and not parts[1]["use_regex"]:
                return "bare"
        return "other"

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4")
        self.used = self.held = 0

    def _full(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def _stretch(self, raw: bytes) -> list[int]:
        """Ids of a piece, or of a stretch that starts and ends where pieces do."""
        if raw.isalpha():  # ASCII letters stand for themselves
            return self._model(raw.decode())
        if raw[:1] == b" " and raw[1:].isalpha() and self.shape == "spaced":
            return self._model("Ġ" + raw[1:].decode())
        text = raw.decode()
        if self.shape == "other" or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._full(text)
        found = _SPACED_PIECES.findall(text) if self.shape == "spaced" else _BARE_PIECES.findall(text.lower())
        return [i for piece in found for i in self._model(piece.encode().decode("latin-1").translate(self.letters))]

    def _learn(self, pieces: list[bytes]) -> None:
        ids: list[int] = []
        sizes = []
        for piece in pieces:
            found = self._stretch(piece)
            ids += found
            sizes.append(len(found))
        n, first = len(self.numbers), self.used
        self.numbers.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used += len(ids)
        while len(self.pool) < self.used:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.sizes) < n + len(pieces):
            self.sizes, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts))
        self.pool[first : self.used] = ids
        self.sizes[n : n + len(pieces)] = sizes
        self.starts[n : n + len(pieces)] = first + np.cumsum(sizes) - sizes
        self.held += 4 * len(ids) + sum(map(len, pieces)) + 200 * len(pieces)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first places of pieces, first places of texts); bytes that belong to no piece are left out."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        kind = _KINDS[data]
        if (data >= 128).any():
            lead = np.nonzero(kind == _LEAD)[0]
            pairs = data[lead].astype(np.uint16) << np.uint16(8) | data[np.minimum(lead + 1, n - 1)]
            plain = lead[~np.isin(pairs, _ODD_PAIRS)]
            kind[lead] = _HARD
            kind[plain] = kind[plain + 1] = _LETTER
        raw = data.tobytes()
        for sign in self.special:
            at = raw.find(sign.encode())
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                kind[offsets[text] : offsets[text + 1]] = _HARD
                at = raw.find(sign.encode(), int(offsets[text + 1]))
        before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[edge[:n]], after[edge[1:]] = _EDGE, _EDGE
        white, white_before = kind <= _WHITE, before <= _WHITE
        if self.shape == "spaced":
            start = edge[:n] | ~white & ((before == _WHITE) | ~white_before & (before != kind)) | white & (~white_before | (after > _WHITE) & (after != _EDGE))
            lower = data
        else:
            start = ~white & (edge[:n] | white_before | (before != kind) | (kind == _DIGIT))
            lower = _LOWER[data]
        ends = np.concatenate([lower, np.zeros(3, np.uint8)])
        mark = np.nonzero(start & (data == 0x27))[0]
        one = np.where(edge[mark + 1], 0, ends[mark + 1])
        two = np.where(edge[mark + 1] | edge[np.minimum(mark + 2, n)], 0, ends[mark + 2])
        short = np.isin(one, list(b"stmd"))
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        for rest in (mark[short] + 2, mark[long] + 3):
            rest = rest[rest < n]
            start[rest] |= ~white[rest] | (self.shape == "spaced")
        hard = kind == _HARD
        keep = None if self.shape == "spaced" else ~white
        if hard.any():
            unit = edge[:n] | (kind == _SPACE) & (before >= _LETTER) & (before <= _OTHER) & (after >= _LETTER) & (after <= _OTHER)
            number = np.cumsum(unit)
            odd = np.zeros(int(number[-1]) + 1, bool)
            odd[number[hard]] = True
            inside = odd[number]
            start = np.where(inside, unit, start)
            if keep is not None:
                keep |= inside
        if keep is None:
            return data, np.nonzero(start)[0], offsets
        place = np.concatenate([[0], np.cumsum(keep)])
        return lower[keep], place[np.nonzero(start)[0]], place[offsets]

    def _numbered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces in order, the texts' first pieces with one more entry at the end)."""
        if self.held > self.capacity:
            self._forget()
        if self.shape == "other":
            cut, starts, places = data, np.unique(offsets[:-1][np.diff(offsets) > 0]), offsets
        else:
            cut, starts, places = self._cut(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(cut)).astype(np.int32))
        values = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(cut))])
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in distinct if p not in self.numbers]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        return numbers[coded.indices.to_numpy()], np.searchsorted(starts, places)

    def _chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
        """(first text, texts, whether the last one goes on, bytes, offsets)."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + self.chunk, "right")) - 1)
            at, end = int(offsets[first]), int(offsets[stop])
            while stop == first + 1 and end - at > self.chunk and self.shape != "other" and (to := self._clean_cut(raw, at, end)):
                yield first, 1, True, raw[at:to], np.array([0, to - at])
                at = to
            if stop == first + 1:
                yield first, 1, False, raw[at:end], np.array([0, end - at])
            else:
                yield first, stop - first, False, raw[at:end], offsets[first : stop + 1] - at
            first = stop

    def _clean_cut(self, raw: np.ndarray, at: int, end: int) -> int:
        """The last space between two ASCII letters or digits in the chunk that starts at ``at``; 0 if there is none."""
        part = raw[at : min(at + self.chunk, end)]
        firm = (_KINDS[part] == _LETTER) | (_KINDS[part] == _DIGIT)
        found = np.nonzero((part[1:-1] == 32) & firm[:-2] & firm[2:])[0]
        return at + int(found[-1]) + 1 if len(found) else 0

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for first, count, _, data, offsets in self._chunks(texts):
            numbers, places = self._numbered(data, offsets)
            total = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
            out[first : first + count] += np.diff(total[places])
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order, as little-endian unsigned 32-bit integers."""
        waiting: list[np.ndarray] = []
        for _, count, goes_on, data, offsets in self._chunks(texts):
            numbers, places = self._numbered(data, offsets)
            sizes = self.sizes[numbers]
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.pool[np.repeat(self.starts[numbers] - total[:-1], sizes) + np.arange(total[-1])]
            if goes_on:
                waiting.append(ids)
                continue
            ends = total[places]
            for n in range(count):
                found = ids[ends[n] : ends[n + 1]]
                if waiting:
                    found, waiting = np.concatenate([*waiting, found]), []
                yield found

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.encode(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept from task to task while no other resource is asked for."""
    return worker_resource(("encoder", path), lambda: Encoder(path))
