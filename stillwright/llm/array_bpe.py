"""Byte-level BPE on ragged numpy arrays, all sequences in step.

A round finds each sequence's lowest-rank pair and applies it everywhere at once; sequences
without a pair leave the arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

NONE = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ArrayBPE:
    """Tokens of byte strings, from the merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.first, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
            self.last[byte] = vocab[letter + (spec["model"].get("end_of_word_suffix") or "")]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys = np.append(key[order], np.int64(2**62))
        self.ranks = np.append(order.astype(np.int32), NONE)
        self.made = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64)[order], 0)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NONE where it does not merge."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each (non-empty) byte string."""
        out = np.zeros(len(pieces), np.int64)
        for row, lens, _ in self._done(pieces):
            out[row] = lens
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each (non-empty) byte string."""
        out = [b""] * len(pieces)
        for row, lens, symbols in self._done(pieces):
            raw, ends = symbols.astype("<u4").tobytes(), np.cumsum(lens) * 4
            for r, begin, end in zip(row.tolist(), (ends - lens * 4).tolist(), ends.tolist(), strict=True):
                out[r] = raw[begin:end]
        return out

    def _done(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Finished sequences as (numbers, lengths, symbols), round by round."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        row = np.arange(len(lens))
        if not len(lens):
            return
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols, ends = self.first[raw], np.cumsum(lens) - 1
        symbols[ends] = self.last[raw[ends]]
        rank, made = self._pairs(symbols, np.append(symbols[1:], 0))
        rank[ends] = NONE
        while len(row):
            least = np.minimum.reduceat(rank, np.cumsum(lens) - lens)
            live = least < NONE
            if not live.all():
                keep = np.repeat(live, lens)
                yield row[~live], lens[~live], symbols[~keep]
                symbols, rank, made = symbols[keep], rank[keep], made[keep]
                row, lens, least = row[live], lens[live], least[live]
                if not len(row):
                    break
            hit = rank == np.repeat(least, lens)
            if (hit[1:] & hit[:-1]).any():  # in a run of touching pairs every second one merges, from the left
                n = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), n, 0))
                hit &= (n - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lens = lens - np.add.reduceat(hit, np.cumsum(lens) - lens, dtype=np.int64)
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            ends = np.cumsum(lens) - 1
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed], made[changed] = self._pairs(symbols[changed], symbols[np.minimum(changed + 1, len(symbols) - 1)])
            rank[ends] = NONE
