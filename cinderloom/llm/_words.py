"""Words of many texts at once, as numpy arrays.

A word is a run of digits, lower-case ASCII letters (after lower-casing A-Z) and characters from
U+0080 on. In UTF-8 every byte of those characters is 0x80 or more, so bytes can be classed one by
one and whole batches are cut and hashed without a Python loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_WORD = np.zeros(256, dtype=np.int8)
_IS_WORD[0x30:0x3A] = 1
_IS_WORD[0x61:0x7B] = 1
_IS_WORD[0x80:] = 1

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
#: Bytes worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Texts worked on at once, however short: what is kept of each text, not its bytes, fills memory then.
BATCH_TEXTS = 2048

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out; nearby values end far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a run of texts: hashes, byte spans in ``data``, and the first word and byte of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1
    at: np.ndarray  # byte offset of each text
    blobs: list[bytes]


def _pieces(low: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BATCH_BYTES that cut no word in two."""
    at = 0
    while at < len(low):
        end = min(at + BATCH_BYTES, len(low))
        while end < len(low) and _IS_WORD[low[end - 1]]:
            gap = np.flatnonzero(_IS_WORD[low[end : end + BATCH_BYTES]] == 0)
            end = end + int(gap[0]) + 1 if len(gap) else min(end + BATCH_BYTES, len(low))
        yield at, end
        at = end


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of a mixed number for each byte and its place in the word. Unlike a polynomial modulo a power
    of two it has no structure by which different words would meet."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = low[np.repeat(starts, size) + place].astype(np.uint64)
    each = mix((letters + np.uint64(1)) * _BYTE + (place.astype(np.uint64) + np.uint64(1)) * _PLACE)
    return mix(np.add.reduceat(each, first) ^ size.astype(np.uint64) * _STEP)


def digests(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic hash of each text's word sequence: its words, lower-cased, with one space after each."""
    low = _LOWER[np.frombuffer(b"\x00".join(blobs) + b"\x00", dtype=np.uint8)]
    word = _IS_WORD[low].astype(bool)
    keep = word.copy()
    keep[1:] |= word[:-1]
    bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs)))))
    at = np.concatenate(([0], np.cumsum(keep)))[bounds].tolist()
    said = np.where(word, low, np.uint8(0x20))[keep].tobytes()
    both = np.array([np.frombuffer(hashlib.blake2b(said[a:b], digest_size=16).digest(), dtype="<i8") for a, b in zip(at[:-1], at[1:], strict=True)]).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def cut(blobs: list[bytes]) -> Words:
    """Words of the texts. Work space is some 60 bytes a byte of BATCH_BYTES (of a longer word), however long a text is."""
    low = _LOWER[np.frombuffer(b"\x00".join(blobs) + b"\x00", dtype=np.uint8)]
    bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs)))))
    found = []
    for at, end in _pieces(low):
        piece = low[at:end]
        edge = np.diff(_IS_WORD[piece], prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found.append((_hashes(piece, starts, ends), starts + at, ends + at))
    hashes, starts, ends = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds), bounds[:-1], blobs)


def batches(texts: list[str | None], most: int = BATCH_TEXTS) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) by groups of about BATCH_BYTES and at most ``most`` texts; null has no words."""
    first, size, blobs = 0, 0, []
    for i, text in enumerate(texts):
        blob = text.encode("utf-8", "surrogatepass") if text else b""
        if blobs and (size + len(blob) > BATCH_BYTES or len(blobs) >= most):
            yield first, cut(blobs)
            first, size, blobs = i, 0, []
        blobs.append(blob)
        size += len(blob)
    if blobs:
        yield first, cut(blobs)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; len - n + 1 values, over text borders too."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= _STEP
        out += hashes[j : j + count]
    return mix(out)
