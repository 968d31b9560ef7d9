"""Sets of hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes of text whose hashes are worked out at once; some forty times as much memory.
CHUNK = 1 << 18
#: Odd constants from a fixed seed: a value for each byte, the step of a word's polynomial, word places in a shingle.
_R = np.random.default_rng(20_240_229)
BYTE = _R.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
STEP = int(_R.integers(0, 1 << 62)) * 4 + 3
BACK = pow(STEP, -1, 1 << 64)
PLACE = _R.integers(0, 1 << 63, 64, dtype=U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (multiply and shift, twice)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of STEP and of its inverse, as far as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", STEP), ("down", BACK)):
                p = np.full(n, base, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))
        return self.up, self.down


POWERS = Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (ASCII letters folded) and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = POWERS.get(len(data))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(BYTE[data] * up[: len(data)], dtype=U)))
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.cumsum(sizes)
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` words.

    Texts with fewer words have one shingle, the whole sequence; texts without words have none.
    """
    out: list[np.ndarray] = []
    at, size = 0, 0
    raw = [(t or "").encode() for t in texts]
    while at < len(raw):
        end = at
        size = 0
        while end < len(raw) and (end == at or size + len(raw[end]) < CHUNK):
            size += len(raw[end])
            end += 1
        hashes, counts = word_hashes(raw[at:end])
        n = max(0, len(hashes) - width + 1)
        rolled = np.zeros(n, U)
        for k in range(width):
            rolled += hashes[k : k + n] * PLACE[k]
        rolled = mix(rolled)
        start = 0
        for c in counts.tolist():
            if c >= width:
                out.append(np.unique(rolled[start : start + c - width + 1]))
            elif c:
                out.append(mix((hashes[start : start + c] * PLACE[width : width + c]).sum(dtype=U, keepdims=True) + U(c)))
            else:
                out.append(np.zeros(0, U))
            start += c
        at = end
    return out
