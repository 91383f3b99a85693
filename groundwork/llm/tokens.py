"""Token ids of whole texts, with the ``tokenizers`` library, at several times its plain speed.

A byte-level BPE with the usual split pattern never lets a token cross a lone space or newline
between two characters that aren't white space, nor pass from a letter to a punctuation mark. A batch of texts is therefore cut there by array
operations, equal chunks are found by Arrow's dictionary encoding, and each distinct chunk is encoded
once for as long as a worker remembers it.

The library's own BPE model turns a chunk's pieces into ids. A chunk of ASCII and Latin letters is
split into pieces by the public pattern here; any other chunk, a text that holds an added token, and
tokenizers of another kind are given to the library whole. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)`` either way.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks, and pieces, in each of the two generations that a worker remembers.
CACHE = 250_000
#: Characters up to which a chunk is remembered.
CACHED_CHARS = 64
#: Bytes of text that are cut at once, which takes some twelve times as many; a longer text comes alone.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Second bytes of three-byte white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0x80, 0x81, 0x9A, 0xA0]] = True
#: Characters whose place in the split pattern is the same in every Unicode version.
_PLAIN = re.compile("[\n -~À-ÖØ-öø-ɏ]+")
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk edges: those of the texts, lone spaces and newlines between other characters, and marks after letters."""
    edges = offsets[np.concatenate(([True], offsets[1:] != offsets[:-1]))]
    if len(data) < 3:
        return edges
    at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
    at = at[~_SPACE[data[at - 1]] & ~_SPACE[data[at + 1]]]
    # white space of several bytes on either side, or what looks like it
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    odd = (one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & _WIDE[two]))
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    odd |= (one == 0xC2) | ((one >= 0xE1) & (one <= 0xE3) & _WIDE[two])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = at[~odd & ~edge[at] & ~edge[at + 1]]
    marks = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    return np.sort(np.concatenate((edges, at, marks[~edge[marks]])), kind="stable")


class Encoder:
    """Encodes texts to little-endian unsigned ids of ``dtype``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(Path(path).read_text())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.chunked = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not spec.get("normalizer")
            and not spec.get("truncation")
        )
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.ascii = {b: self.letters[b] for b in (10, 32)}
        self.cache = CACHE
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop what is remembered: the next task's texts share little with it, and other stages need the memory."""
        self.young, self.old = {}, {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _remember(self, text: str, found: bytes) -> bytes:
        """When the younger generation is full, the older is forgotten."""
        if len(text) <= CACHED_CHARS:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.young.get(piece) or self.old.get(piece)
        if found is None:
            found = self._remember(piece, self._model(piece))
        return found

    def _model(self, piece: str) -> bytes:
        """Ids of one match of the split pattern."""
        if piece.isascii():
            letters = piece.translate(self.ascii)
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _chunk(self, text: str, whole: bool) -> bytes:
        """Ids of a chunk that the younger generation doesn't hold."""
        found = self.old.get(text)
        if found is None:
            if not whole and _WORD.fullmatch(text):
                found = self._model(text)
            elif whole or not _PLAIN.fullmatch(text):
                found = self._plain(text)
            else:
                found = b"".join([self._piece(p) for p in self.split(text)])
        return self._remember(text, found)

    def _slice(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of ``data`` and where each begins; ``whole``: texts that aren't cut."""
        edges = cuts(data, offsets)
        if whole.any():
            text = np.searchsorted(offsets, edges, "right") - 1
            inner = whole[np.minimum(text, len(whole) - 1)] & (edges != offsets[text])
            edges = edges[~inner]
        chunks = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(data)]
        ).dictionary_encode()
        odd = bool(whole.any())
        codes = [self.young.get(c) or self._chunk(c, odd) for c in chunks.dictionary.cast(pa.large_string()).to_pylist()]
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        at = chunks.indices.to_numpy()
        own = size[at]
        ends = np.cumsum(own)
        ids = np.frombuffer(b"".join(codes), self.dtype)[np.repeat(first[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(edges, offsets)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), end to end, and the n + 1 places where each begins."""
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        whole = np.zeros(n, bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not self.chunked:
            whole[:] = True
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        parts, places, done, k = [], [np.zeros(1, np.int64)], 0, 0
        while k < n:
            e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE_BYTES, "right")) - 1)
            own = offsets[k : e + 1]
            ids, at = self._slice(data[own[0] : own[-1]], own - own[0], whole[k:e])
            parts.append(ids)
            places.append(at[1:] + done)
            done += len(ids)
            k = e
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.concatenate(places)


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def closed(enc: Encoder, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """As :meth:`Encoder.encode`, with ``end_id`` after every text."""
    ids, at = enc.encode(texts)
    if end_id is None:
        return ids, at
    n = len(at) - 1
    out = np.empty(len(ids) + n, enc.dtype)
    new = at + np.arange(n + 1)
    mask = np.ones(len(out), bool)
    mask[new[1:] - 1] = False
    out[mask] = ids
    out[~mask] = end_id
    return out, new
