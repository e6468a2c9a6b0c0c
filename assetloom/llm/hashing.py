"""Vectorised word hashing for tasks: texts in, one 64-bit hash per word out."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes hashed at once; longer texts are cut at separators, so memory stays bounded.
PIECE = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public constants of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15) + _U(1))


_BYTE = _table(256, 1000)
_PLACE = _table(1 << 16, 5000) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[0x41:0x5B] += 0x20


def _hash_piece(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~gap[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), starts, ends
    first = starts[0]
    place = np.arange(first, len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    with np.errstate(over="ignore"):
        part = _BYTE[raw[first:]] * _PLACE[place & 0xFFFF]
        part[~inside[first:]] = 0
        return mix64(np.add.reduceat(part, starts - first) + (ends - starts).astype(_U)), starts, ends


def word_hashes(texts: list[bytes], alnum: bool = False, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text plus the total). Words are runs of bytes other than
    ASCII white space, or with ``alnum`` runs of ASCII letters, digits and non-ASCII bytes; A-Z are lower-cased."""
    gap = _NOT_ALNUM if alnum else _SPACE
    hashes, counts, batch, size = [], [], [], 0

    def flush() -> None:
        nonlocal batch, size
        if not batch:
            return
        raw = np.frombuffer(b" ".join(batch), np.uint8)
        raw = _ASCII_LOWER[raw] if lower else raw
        h, starts, _ = _hash_piece(raw, gap)
        bounds = np.cumsum([0, *(len(b) + 1 for b in batch)])
        counts.extend(np.diff(np.searchsorted(starts, bounds)).tolist())
        hashes.append(h)
        batch, size = [], 0

    for text in texts:
        if len(text) > PIECE:
            flush()
            n, at = 0, 0
            while at < len(text):
                end = min(at + PIECE, len(text))
                while end < len(text) and not gap[text[end]]:  # never inside a word
                    end += 1
                h, _, _ = _hash_piece(_ASCII_LOWER[np.frombuffer(text[at:end], np.uint8)] if lower else np.frombuffer(text[at:end], np.uint8), gap)
                hashes.append(h)
                n, at = n + len(h), end
            counts.append(n)
            continue
        batch.append(text)
        size += len(text) + 1
        if size > PIECE:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, _U)), np.cumsum([0, *counts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; one for the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, _U)
        for k in range(size):
            total = (total + words[k : k + n]) * _U(0x9E3779B97F4A7C15)
            total ^= total >> _U(29)
        return mix64(total + _U(size))


def utf8(series) -> list[bytes]:
    """The UTF-8 bytes of each text; empty for null."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in series]
