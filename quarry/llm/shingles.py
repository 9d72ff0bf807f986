"""Words and word shingles of whole texts as 64-bit hashes, in numpy over a batch of texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D, after A-Z is lower-cased. Its hash is a polynomial over random byte
values, modulo 2^64, mixed; a shingle's hash is a mixed sum of its words' hashes, each times its own odd factor.
"""
from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed at once: it bounds memory for texts of any length.
CHUNK = 1 << 21
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(0, 2**64, dtype=np.uint64)) | 5
_BACK = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, CHUNK + 4096), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in raw bytes."""
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    solid = np.concatenate([[False], ~((low == 32) | ((low >= 9) & (low <= 13))), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * _powers(_BASE, len(low)), dtype=np.uint64)])
    value = (total[ends] - total[starts]) * _powers(_BACK, len(low))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _FACTOR[60]), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the first place of each text's words (one more than texts)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    buffer = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = at + CHUNK
        if end < len(buffer):  # to the next white space
            step = 1024
            while True:
                tail = buffer[end : end + step]
                gap = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
                if len(gap) or end + step >= len(buffer):
                    end = end + int(gap[0]) if len(gap) else len(buffer)
                    break
                step *= 4
        h, s = _hash_words(buffer[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    hashes, starts = np.concatenate(hashes), np.concatenate(starts)
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingles. Fewer words than `width` make one shingle; none make an empty set."""
    words, first = word_hashes(texts)
    spread = mix(words)
    n = len(words)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        whole += spread[k : n - width + 1 + k] * _FACTOR[k] if n >= width else np.zeros(0, np.uint64)
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            one = (spread[a:b] * _FACTOR[: b - a]).sum(dtype=np.uint64, keepdims=True) + _FACTOR[50 + int(b - a) % 8]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    with np.errstate(over="ignore"):
        a = mix(mix(shingles * _FACTOR[40]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles)))
        b = mix(mix(shingles ^ _FACTOR[41]).sum(dtype=np.uint64, keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
