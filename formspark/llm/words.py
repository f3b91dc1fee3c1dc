"""Words of many texts at once, as hashes and byte places in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes of words in lower-cased UTF-8: digits, letters and everything beyond ASCII
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: bytes of text handled at a time
BLOCK = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, np.uint64(b))
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _POWERS[k : k + 1] = [x]
    return _POWERS[0], _POWERS[1]


def _cut(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text, no longer than a block unless a word is; never within a word."""
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        tail = np.frombuffer(text[at:end], np.uint8)
        gaps = np.flatnonzero(~WORD_BYTE[tail])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            rest = np.flatnonzero(~WORD_BYTE[np.frombuffer(text[end:], np.uint8)])
            end = end + int(rest[0]) + 1 if len(rest) else len(text)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text index, first byte, end byte, 64-bit hash) of the words of lower-cased texts."""
    parts, docs, offsets, sizes, size = [], [], [], [], 0
    for d, text in enumerate(texts):
        for at, piece in _cut(text):
            if size + len(piece) > BLOCK and parts:
                yield _block(parts, docs, offsets, sizes)
                parts, docs, offsets, sizes, size = [], [], [], [], 0
            parts.append(piece)
            docs.append(d)
            offsets.append(at)
            sizes.append(len(piece) + 1)
            size += len(piece) + 1
    if parts:
        yield _block(parts, docs, offsets, sizes)


def _block(parts, docs, offsets, sizes):
    flat = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    edge = np.diff(np.r_[False, WORD_BYTE[flat], False].view(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_VALUES[flat] * power[: len(flat)], out=total[1:])
    h = (total[end] - total[begin]) * inverse[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    starts = np.cumsum([0, *sizes[:-1]])
    piece = np.searchsorted(starts, begin, "right") - 1
    shift = np.asarray(offsets)[piece] - starts[piece]
    return np.asarray(docs)[piece], begin + shift, end + shift, h
