"""Sets of word shingles as sorted 64-bit hashes, for many texts at a time with array operations."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, np.int64).astype(U)
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte values times powers, and the inverse powers: bytes i to j hash to (sums[j] - sums[i]) * inverse[i]."""
    n = max(CHUNK, 1 << int(len(data)).bit_length())
    power, inverse = _powers(n)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The set of each text: hashes of every `width` words in a row, A-Z lower-cased; of all its words if there are fewer."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").lower() if t else b""
        if group and size + len(b) > CHUNK:
            out += _sets(group, width)
            group, size = [], 0
        group.append(b)
        size += len(b) + 1
    return out + (_sets(group, width) if group else [])


def _sets(group: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    sums, inverse = prefix_hashes(data)
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
    offsets = np.cumsum([0] + [len(b) + 1 for b in group])
    first = np.searchsorted(starts, offsets)
    padded = np.r_[words, np.zeros(width, U)]
    run = np.zeros(len(words), U)
    for i in range(width):
        run = run * U(0xD6E8FEB86659FD93) + padded[i : i + len(words)]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * U(0xA0761D6478BD642F) + w
            out.append(mix(np.array([h], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that name the set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sets that are not empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
