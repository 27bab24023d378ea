"""Word shingles of many texts at once, as sorted arrays of 62-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SHINGLE = 5
SEGMENT = 1 << 20
_RANDOM = np.random.default_rng(20250117)
#: A random number for each byte; A-Z count as a-z.
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_STEP = int(_RANDOM.integers(0, 1 << 63)) * 2 + 1
_PLACE = _RANDOM.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOW62 = np.uint64((1 << 62) - 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, for ``n`` bytes at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1024)
        _powers[:] = [np.full(size, x, dtype=np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
        for powers in _powers:
            powers[0] = 1
            np.cumprod(powers, out=powers)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of a buffer, and where the words start."""
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = ~_WHITE[buf]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and where each text's words begin (one more entry than texts).

    The buffer is hashed in segments that end at white space, so that a long text needs little more than itself.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    hashes, places, at = [], [], 0
    while at < len(buf):
        end = min(at + SEGMENT, len(buf))
        if end < len(buf):
            white = np.flatnonzero(_WHITE[buf[at:end]])
            if len(white):
                end = at + int(white[-1]) + 1
            else:
                rest = np.flatnonzero(_WHITE[buf[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(buf)
        h, starts = _hash_words(buf[at:end])
        hashes.append(h)
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begins)


def _rolled(words: np.ndarray) -> np.ndarray:
    """The hash of each five words in a row."""
    n = max(0, len(words) - SHINGLE + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += words[k : k + n] * _PLACE[k]
    return (mixed(rolled) & _LOW62).astype(np.int64)


def token_sequences(texts: Sequence[str]) -> list[np.ndarray]:
    """For each text its shingles in order, repeats included; none for a text of fewer words."""
    if not texts:
        return []
    words, at = word_hashes(texts)
    rolled = _rolled(words)
    return [rolled[int(a) : max(int(a), int(b) - SHINGLE + 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def shingle_sets(texts: Sequence[str]) -> list[np.ndarray]:
    """For each text its distinct shingles as a sorted int64 array; a text of fewer words is one shingle."""
    if not texts:
        return []
    words, at = word_hashes(texts)
    rolled = _rolled(words)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(np.array([mixed(np.array([whole], dtype=np.uint64))[0] & _LOW62], dtype=np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out


def texts_in_parts(texts: Sequence[str | None], size: int = SEGMENT):
    """Slices (from, to) of a list of texts with about ``size`` characters each."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
