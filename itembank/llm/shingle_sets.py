"""Distinct word shingles of texts as sorted 64-bit hashes, many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BATCH_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _group(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = ~_SPACE[data]
    at = np.flatnonzero(solid)
    if not len(at):
        return [np.empty(0, np.uint64)] * len(texts)
    first = np.append(True, np.diff(at) > 1)
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, sizes)
    words = mix(np.add.reduceat(_BYTES[data[at]] * _powers(int(sizes.max()))[place], heads) + sizes.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(at[heads], ends)])
    padded = np.concatenate([words, np.zeros(WORDS - 1, np.uint64)])
    grams = padded[: len(words)] * _PLACES[0]
    for k in range(1, WORDS):
        grams = grams + padded[k : k + len(words)] * _PLACES[k]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(grams[a : b - WORDS + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            few = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text: runs of WORDS words, or all words where there are fewer.

    A-Z are lower-cased; words are what ASCII white space leaves apart.
    """
    out, group, size = [], [], 0
    for text in texts:
        group.append(text.encode("utf-8", "surrogatepass").lower())
        size += len(group[-1])
        if size >= BATCH_BYTES:
            out += _group(group)
            group, size = [], 0
    return out + (_group(group) if group else [])


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that tell a set from others."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)
