"""Vectorised word hashing: whole batches of texts become arrays of 64-bit word hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 18  # bytes hashed at a time, which bounds the working memory; one longer text is a block of its own
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: 1 for the bytes of a word: ASCII letters, digits, and all bytes of other characters
WORD = np.zeros(256, np.uint8)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: 1 for all but ASCII white space
SOLID = np.ones(256, np.uint8)
SOLID[[9, 10, 11, 12, 13, 32]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse mod 2**64."""
    size = 1 << max(18, (n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
        out = []
        for base in (PRIME, inverse):
            a = np.empty(size, np.uint64)
            a[0] = 1
            done = 1
            step = base
            while done < size:
                with np.errstate(over="ignore"):
                    a[done : 2 * done] = a[:done] * step
                    step = step * step
                done *= 2
            out.append(a)
        if size > 1 << 19:
            return out[0], out[1]
        _powers[size] = (out[0], out[1])
    return _powers[size]


def blocks(texts: list[str | None], lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, last, bytes, starts): texts first..last-1 as UTF-8, each followed by a space; starts has one more entry than texts."""
    coded: list[bytes] = []
    first, size = 0, 0
    for k, t in enumerate(texts):
        t = t or ""
        b = (t.lower() if lower else t).encode("utf-8", "replace")
        if coded and size + len(b) > BLOCK:
            yield first, k, *_join(coded)
            coded, first, size = [], k, 0
        coded.append(b)
        size += len(b) + 1
    if coded:
        yield first, len(texts), *_join(coded)


def _join(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    starts = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in coded], out=starts[1:])
    return data, starts


def hashes(data: np.ndarray, starts: np.ndarray, kind: np.ndarray = WORD, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block, the first word's index of each text (one more entry than texts), and the words' byte lengths.

    With stem, the last is instead the hashes of the words' first stem bytes.
    """
    solid = kind[data]
    edge = np.flatnonzero(np.diff(solid, prepend=np.uint8(0)))
    begin, end = edge[0::2], edge[1::2]  # the block ends with a space, so words come in whole pairs
    p, q = _pow(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
        h = mix((total[end] - total[begin]) * q[begin] + (end - begin).astype(np.uint64))
        if stem:
            end = np.minimum(end, begin + stem)
            return h, np.searchsorted(begin, starts), mix((total[end] - total[begin]) * q[begin] + np.uint64(1 << 40))
    return h, np.searchsorted(begin, starts), end - begin
