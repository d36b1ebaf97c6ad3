"""Vectorised word and shingle hashes (numpy, inside Spark tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes.  A word's hash is a polynomial
over a random 64-bit value per byte, taken as a difference of running sums; a shingle's
hash combines the hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, PIECE + 4096), base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.cumprod(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [starts, ends) of ``buf`` (at most a few MB)."""
    with np.errstate(over="ignore"):
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power(_P, len(buf), "p"), out=run[1:])
        return mix((run[ends] - run[starts]) * _power(_PINV, len(buf) + 1, "inv")[starts]
                   + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of ``buf``."""
    edge = np.ones(len(buf) + 2, bool)
    edge[1:-1] = _SEP[buf]
    d = np.diff(edge.view(np.int8))
    return np.flatnonzero(d == -1), np.flatnonzero(d == 1)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of at most about PIECE bytes, cut at separators (a single longer word stays whole)."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            if cut <= at:
                nxt = [p for p in (raw.find(b" ", end), raw.find(b"\n", end)) if p >= 0]
                cut = min(nxt, default=len(raw))
            end = cut
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of all words of one text, in order, in bounded pieces."""
    out = []
    for piece in _pieces(raw):
        buf = np.frombuffer(piece, np.uint8)
        s, e = word_spans(buf)
        out.append(span_hashes(buf, s, e))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles; with 1 to k-1 words the whole sequence is the only shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        k = n
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = (h + words[j:n - k + 1 + j]) * _P
            h ^= h >> np.uint64(31)
    return mix(h)


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` universal hash functions x -> a*x + b (mod 2^64, a odd)."""
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            r.integers(0, 1 << 63, n, dtype=np.uint64))


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Per set the minimum under every hash function: (len(sets), len(a)); all ones for an empty set."""
    out = np.full((len(sets), len(a)), np.iinfo(np.uint64).max, np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(full):
            take, size = [], 0
            while at < len(full) and (not take or size + len(sets[full[at]]) <= block):
                take.append(full[at])
                size += len(sets[full[at]])
                at += 1
            x = np.concatenate([sets[i] for i in take])
            cuts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in take])[:-1]])
            for j in range(len(a)):
                out[take, j] = np.minimum.reduceat(x * a[j] + b[j], cuts)
    return out
