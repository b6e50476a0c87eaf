"""Vectorised words and hashes: a block of texts becomes arrays of word and window hashes."""

from __future__ import annotations

import numpy as np

#: Odd 64-bit multipliers of the splitmix64 finaliser.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def constants(n: int, seed: int = 0) -> np.ndarray:
    """n odd 64-bit constants made from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.full(n, seed * 0x5851F42D4C957F2D & MASK, np.uint64)) | np.uint64(1)


class _Powers:
    """Powers of BASE modulo 2**64, made as far as the longest word needs."""

    def __init__(self) -> None:
        self.table = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024), BASE, dtype=np.uint64))])
        return self.table


_powers = _Powers()


def byte_class(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    inside = np.ones(256, dtype=bool)
    inside[np.frombuffer(separators, dtype=np.uint8)] = False
    return inside


class Words:
    """Words of a block of texts: byte spans, 64-bit hashes and the text each belongs to."""

    def __init__(self, encoded: list[bytes], inside: np.ndarray) -> None:
        """inside: what bytes are parts of words; a space must not be one."""
        self.buffer = b" ".join(encoded) + b" "
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        self.begins = np.cumsum([0, *(len(x) + 1 for x in encoded)])
        word = inside[raw]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        lens = self.ends - self.starts
        values = raw[word].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(lens) - lens
        if len(lens):
            place = np.arange(len(values)) - np.repeat(first, lens)
            values *= _powers.upto(int(lens.max()))[place]
            self.hashes = mix(np.add.reduceat(values, first) ^ (lens.astype(np.uint64) << np.uint64(40)))
        else:
            self.hashes = np.empty(0, np.uint64)
        #: bounds[i], bounds[i + 1]: the words of text i
        self.bounds = np.searchsorted(self.starts, self.begins)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `size` words within one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        owner = self.owner()
        at = np.flatnonzero(owner[:n] == owner[size - 1 :])
        total = np.zeros(n, np.uint64)
        for j, c in enumerate(constants(size, seed + 1)):
            total += self.hashes[j : n + j] * c
        return at, mix(total[at])
