"""Texts as arrays of word hashes, without a Python object for each word: what operators on word sequences share."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer word is taken whole.
CHUNK = 1 << 17
#: What parts words in the operators on word sequences: space, tab, LF, VT, FF and CR.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """A hash of the ordered pair (a, b): unsigned 64-bit arrays, elementwise."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += b * np.uint64(0xC2B2AE3D27D4EB4F) if isinstance(b, np.ndarray) else np.uint64(b * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    h += np.uint64(salt * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """Polynomial hashes of words, by prefix sums: a word's sum over bytes of value(byte) * base^place, shifted to place 0,
    modulo 2^64, then mixed with its length. A lane has its own base and values."""

    BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

    def __init__(self, lanes: int = 1):
        self.values = [mixed(np.arange(1, 257, dtype=np.uint64), k, 3) for k in range(lanes)]
        self.powers, self.inverses = [], []
        for base in self.BASES[:lanes]:
            for table, x in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                steps = np.full(CHUNK, x, np.uint64)
                steps[0] = 1
                table.append(np.cumprod(steps))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """A hash, never 0, for each word data[start:end] and lane."""
        out = [np.empty(len(starts), np.uint64) for _ in self.values]
        at = 0
        while at < len(starts):
            first = starts[at]
            upto = max(at + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
            if ends[at] - first > CHUNK:  # a word longer than a chunk: of its chunks' hashes
                parts = np.arange(first, ends[at], CHUNK)
                hashed = self(data, parts, np.append(parts[1:], ends[at]))
                for lane, h in enumerate(hashed):
                    total = np.zeros(1, np.uint64)
                    for x in h:
                        total = mixed(total, np.array([x]), 5)
                    out[lane][at] = total[0] | np.uint64(1)
                at += 1
                continue
            piece, s, e = data[first : ends[upto - 1]], starts[at:upto] - first, ends[at:upto] - first
            for lane, values in enumerate(self.values):
                v = values[piece]
                v *= self.powers[lane][: len(v)]
                sums = np.empty(len(v) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(v, out=sums[1:])
                h = sums[e] - sums[s]
                h *= self.inverses[lane][s]
                h = mixed(h, (e - s).astype(np.uint64), 7)
                h[h == 0] = 1
                out[lane][at:upto] = h
            at = upto
        return out


def bounds(data: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of each word in bytes; ``parting`` says of each byte value whether it parts words."""
    apart = np.ones(len(data) + 2, np.int8)
    apart[1:-1] = parting[data]
    step = np.diff(apart)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)
