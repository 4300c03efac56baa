"""Vectorised tokens: runs of one byte class in a batch of documents, with 64-bit hashes, in whole-array steps."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

#: Bytes that are hashed at once.
WINDOW = 1 << 20

#: ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def lower_table() -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    t = np.arange(256, dtype="u1")
    t[65:91] += 32
    return t


def word_classes() -> np.ndarray:
    """0: blank, 1: part of a word."""
    t = np.ones(256, "u1")
    t[list(BLANKS)] = 0
    return t


def shape_classes() -> np.ndarray:
    """0: blank, 1: letter, digit or byte of a longer character, 2: other."""
    t = np.full(256, 2, "u1")
    t[list(BLANKS)] = 0
    t[48:58] = t[65:91] = t[97:123] = 1
    t[128:] = 1
    return t


@cache
def _values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, np.uint64(pow(int(_BASE), -1, 2**64))
    up, down = np.full(n, _BASE, "u8"), np.full(n, inverse, "u8")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the documents, their bytes) of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], "i8" if pa.types.is_large_binary(column.type) else "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    data = np.frombuffer(column.buffers()[2], "u1") if column.buffers()[2] is not None else np.zeros(0, "u1")
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def tokens(offsets: np.ndarray, data: np.ndarray, classes: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, document's place in the batch) of every run of a class over 0; runs end with their document.

    Bytes are worked through in windows of WINDOW; a run that a window cuts goes on in the next, so what is held beside
    the tokens does not grow with a text, and one run may be of any length.
    """
    hashes, kinds, docs = [], [], []
    held: tuple[int, int, int, int] | None = None  # sum, length, class and document of the run that a window cut

    def give(sums: np.ndarray, size: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> None:
        hashes.append(mix(sums + size.astype("u8")))
        kinds.append(kind)
        docs.append(doc)

    def give_held() -> None:
        give(*(np.array([x], t) for x, t in zip(held, ("u8", "i8", "u1", "i8"), strict=True)))

    up, down = _powers(max(16, min(data.size, WINDOW).bit_length()))
    for at in range(0, data.size, WINDOW):
        part = data[at : at + WINDOW]
        n = part.size
        kind = classes[part]
        cut = np.empty(n, bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        inside = offsets[(offsets > at) & (offsets < at + n)] - at
        cut[inside] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        total = np.empty(n + 1, "u8")
        total[0] = 0
        np.cumsum(_values()[part if fold is None else fold[part]] * up[:n], out=total[1:])
        sums, size, kind = (total[end] - total[start]) * down[start], end - start, kind[start]
        doc = np.searchsorted(offsets, start + at, side="right") - 1
        if held:
            if held[2] == kind[0] and held[3] == doc[0]:
                power = pow(int(_BASE), held[1], 2**64)
                sums[0] = (held[0] + power * int(sums[0])) % 2**64
                size[0] += held[1]
            elif held[2]:
                give_held()
        held = (int(sums[-1]), int(size[-1]), int(kind[-1]), int(doc[-1]))
        keep = np.flatnonzero(kind[:-1] > 0)
        give(sums[keep], size[keep], kind[keep], doc[keep])
    if held and held[2]:
        give_held()
    if not hashes:
        return np.zeros(0, "u8"), np.zeros(0, "u1"), np.zeros(0, "i8")
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate(docs)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of n tokens within a document."""
    if hashes.size < n:
        return hashes[:0], doc[:0]
    size = hashes.size - n + 1
    out = np.zeros(size, "u8")
    for k in range(n):
        out = mix(out * _BASE + hashes[k : k + size])
    inside = doc[:size] == doc[n - 1 :]
    return out[inside], doc[:size][inside]
