"""Improbable-feature digests: byte windows of rare entropy in chained Bloom filters.

Every window of WIDTH bytes has an entropy; the farther it lies from what text has as a rule,
the rarer the window. The rarest window of each neighbourhood is a feature. Features go, in text
order, into Bloom filters of a fixed fill; two digests are compared by the bits that filters share
beyond chance. A digest depends on its text alone, so equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import STEP_CHARS, shuffle_partitions, texts
from stillwright.llm.wordhash import constants, mix

#: Bytes of a window, windows of a neighbourhood, neighbourhoods that must choose a window.
WIDTH, NEIGHBOURS, POPULAR = 16, 24, 3
#: Texts of so many windows at most have smaller neighbourhoods, so that they too have some features.
SHORT, SHORT_NEIGHBOURS = 192, 6
#: Entropy in bits that text has as a rule in such a window, and the least a feature may have.
TYPICAL, LEAST = 3.2, 1.2
#: Bits and hashes of a filter, and the features it takes.
BITS, HASHES, FILL = 2048, 5, 160
LEVELS = 1000
#: Neighbourhoods of a slice; texts of more bytes are digested by slices.
SLICE = 1_000_000


def neighbours(windows: int) -> int:
    """Windows of a neighbourhood in a text of so many windows."""
    return SHORT_NEIGHBOURS if windows <= SHORT else NEIGHBOURS


class Digests:
    """Bloom filters of a block of byte strings; filters[bounds[i]:bounds[i + 1]] are of the i-th."""

    def __init__(self, block: list[bytes], slice_bytes: int = SLICE) -> None:
        padded = [x.ljust(WIDTH, b"\0") if x else x for x in block]
        # long texts by slices, all others together
        long = [i for i, x in enumerate(padded) if len(x) > slice_bytes]
        found = [self._together([b"" if len(x) > slice_bytes else x for x in padded])] + [self._sliced(padded[i], slice_bytes, i) for i in long]
        h, who = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        if long:
            order = np.argsort(who, kind="stable")
            h, who = h[order], who[order]
        self.counts = np.bincount(who, minlength=len(block))
        filters = -(-self.counts // FILL)
        self.bounds = np.cumsum([0, *filters])
        place = np.arange(len(who)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        row = self.bounds[who] + place // FILL
        bits = np.zeros(int(self.bounds[-1]) * BITS, bool)
        for k in range(HASHES):
            bits[row * BITS + ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.filters = np.packbits(bits).reshape(-1, BITS // 8)

    def _together(self, padded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the features of a block, in order, and the texts they are of."""
        gap = b"\0" * NEIGHBOURS
        raw = np.frombuffer(gap.join(padded) + gap + b"\0" * WIDTH, np.uint8)
        lens = np.array([len(x) for x in padded], np.int64)
        begins = np.cumsum(lens + NEIGHBOURS) - lens - NEIGHBOURS
        windows = np.maximum(lens - WIDTH + 1, 0)
        owner = np.repeat(np.arange(len(padded)), windows)
        at = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
        level = np.full(len(raw), LEVELS + 1, np.int64)
        level[at] = self._levels(raw)[at]
        chosen, who = self._popular(level, at, owner, windows)
        return self._hashed(raw, chosen), who

    @staticmethod
    def _hashed(raw: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Hashes of the windows at the chosen places."""
        data = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[chosen]).view(np.uint64)
        return mix((mix(data) * constants(WIDTH // 8, 7)).sum(axis=1, dtype=np.uint64))

    def _sliced(self, text: bytes, size: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text of more than SHORT windows, by slices of so many neighbourhoods: each has the bytes that
        its last neighbourhood reaches, and a choice that crosses an edge is counted over both slices."""
        raw = np.frombuffer(text, np.uint8)
        starts = len(raw) - WIDTH + 1 - NEIGHBOURS + 1
        bests, counts = [], []
        for begin in range(0, starts, size):
            mine = raw[begin : min(begin + size, starts) + NEIGHBOURS - 1 + WIDTH - 1]
            least = self._levels(mine)[: len(mine) - WIDTH + 1] << 40 | np.arange(len(mine) - WIDTH + 1)
            span = 1
            while span < NEIGHBOURS:
                step = min(span, NEIGHBOURS - span)
                least[:-step] = np.minimum(least[:-step], least[step:])
                span += step
            best = (least[: len(least) - NEIGHBOURS + 1] & ((1 << 40) - 1)) + begin
            new = np.flatnonzero(np.diff(best, prepend=-1))
            bests.append(best[new])
            counts.append(np.diff(np.append(new, len(best))))
        best, times = np.concatenate(bests), np.concatenate(counts)
        new = np.flatnonzero(np.diff(best, prepend=-1))
        best, times = best[new], np.add.reduceat(times, new)
        keep = times >= min(POPULAR, starts)
        best = best[keep] if keep.any() else best
        h = np.concatenate([self._hashed(raw, best[k : k + size]) for k in range(0, len(best), size)])
        return h, np.full(len(h), number)

    @staticmethod
    def _levels(raw: np.ndarray) -> np.ndarray:
        """How common the entropy of the window at each place is: 0 for the rarest."""
        n = len(raw)
        order = np.argsort(raw, kind="stable")
        key = raw[order].astype(np.int64) * (2 * n) + order
        place = np.arange(n)
        before, after = np.empty(n, np.int64), np.empty(n, np.int64)
        before[order] = place - np.searchsorted(key, key - (WIDTH - 1))
        after[order] = np.searchsorted(key, key + (WIDTH - 1), side="right") - place - 1
        c = np.arange(WIDTH + 1)
        # sum of c log c over a window's byte counts, in fixed point, so that equal windows have equal sums
        g = np.rint(c * np.log2(np.maximum(c, 1)) * 65536).astype(np.int64)
        step = np.diff(g)
        total = np.empty(n - WIDTH + 1, np.int64)
        total[0] = g[np.bincount(raw[:WIDTH], minlength=256)].sum()
        total[1:] = total[0] + np.cumsum(step[before[WIDTH:]] - step[after[: n - WIDTH]])
        entropy = np.log2(WIDTH) - total / (65536 * WIDTH)
        far = np.abs(entropy - TYPICAL) / max(TYPICAL, np.log2(WIDTH) - TYPICAL)
        out = np.full(n, LEVELS, np.int64)
        out[: n - WIDTH + 1] = np.where(entropy < LEAST, LEVELS, np.rint((1 - far) * (LEVELS - 1)))
        return out

    @staticmethod
    def _popular(level: np.ndarray, at: np.ndarray, owner: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that are the rarest (then first) of enough neighbourhoods, and their owners."""
        least = level << 40 | np.arange(len(level))
        short, span = windows <= SHORT, 1
        found = np.empty(len(at), np.int64)
        for size, mine in ((SHORT_NEIGHBOURS, short), (NEIGHBOURS, ~short)):
            while span < size:
                step = min(span, size - span)
                least[:-step] = np.minimum(least[:-step], least[step:])
                span += step
            of = mine[owner]
            found[of] = least[at[of]]
        # a text has at least one neighbourhood, and none reaches beyond its last window
        number = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
        many = np.maximum(windows - np.where(short, SHORT_NEIGHBOURS, NEIGHBOURS) + 1, np.minimum(windows, 1))
        starts = number < np.repeat(many, windows)
        best, who = found[starts] & ((1 << 40) - 1), owner[starts]
        new = np.flatnonzero(np.diff(best, prepend=-1))
        times = np.diff(np.append(new, len(best)))
        best, who = best[new], who[new]
        keep = times >= np.minimum(POPULAR, many[who])
        lost = np.setdiff1d(np.unique(who), who[keep])
        if len(lost):
            keep |= np.isin(who, lost)
        return best[keep], who[keep]

    def of(self, i: int) -> np.ndarray:
        return self.filters[self.bounds[i] : self.bounds[i + 1]]

    def text(self, i: int) -> str:
        return f"{self.counts[i]}:{base64.b64encode(self.of(i).tobytes()).decode()}"


def parse(digest: str) -> np.ndarray:
    """The filters of a digest's text."""
    return np.frombuffer(base64.b64decode(digest.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: bits that filters share beyond chance, each with its best partner, by bits, both ways."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    na, nb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64).astype(float) for x in (a, b))
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    for i, row in enumerate(a):  # a row at a time: memory stays that of the longer digest
        shared = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        chance = na[i] * nb / BITS
        chance += 2 * np.sqrt(chance * (1 - na[i] / BITS) * (1 - nb / BITS))
        most = np.minimum(na[i], nb)
        score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
        best_a[i] = score.max()
        np.maximum(best_b, score, out=best_b)
    return float((best_a @ na / na.sum() + best_b @ nb / nb.sum()) / 2)


def edited(text: str, following: str) -> str:
    """text whose last third is replaced by the beginning of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Rows without an id are dealt below all ids, by a hash of their text: to places from LAST on.
LAST, PLACES = -(2**63), 2**40
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(rows: list[tuple]) -> Iterator[tuple]:
    """Result rows of all but the last of `rows`, (bucket, borrowed, doc_id, text) in order."""
    mine = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
    changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in mine]
    d = Digests([r[3].encode() for r in rows] + changed)
    for k, i in enumerate(mine):
        e = len(rows) + k
        yield (rows[i][2], len(rows[i][3]), hashlib.sha256(changed[k]).hexdigest(), d.text(i), d.text(e), likeness(d.of(i), d.of(e)), likeness(d.of(i), d.of(i + 1)))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found := list(_results(rows)):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows.append(row)
            held += len(row[3])
            if held > STEP_CHARS and len(rows) > 1:
                yield from out(rows)
                rows, held = rows[-1:], len(row[3])
    yield from out(rows)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Digests of every whole text and of its edited text, and how near they come; see RESULT.

    The next document is the one with the next smaller doc_id; the first follows the last, so a
    single document follows itself. Null ids come last, in an order of text hashes; rows of one id are
    ordered by their text, and one range holds them. An id below -2**63 + 2**40 would stand among null ones.
    Null text is empty; an empty text has no features: it is like another empty one (1) and unlike
    any other (0). Repeated rows stay. An empty table gives an empty result. Texts of more than SLICE bytes are digested by
    slices, so besides a few copies of a text memory is that of a slice. Comparing two digests takes
    time by the product of their lengths, some 26,000 filters for 100 MB of text. Other columns are not read.

    The texts are shuffled once, into ranges of ids; the first row of each range is also sent to
    the range before. To the driver come two numbers a range, not the ids of documents.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    ranges = 4 * n  # several to a partition, so that where they fall by hash evens out
    rows = texts(docs).withColumn("k", F.coalesce("doc_id", F.lit(LAST) + F.pmod(F.xxhash64("text"), F.lit(PLACES))))
    cuts = np.array(rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges)).alias("c")).first()["c"] or [], np.int64)
    cuts = np.unique(cuts)

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, k.to_numpy(), side="left"), dtype="int32")

    heads = {r["b"]: r["k"] for r in rows.select("k", bucket_of("k").alias("b")).groupBy("b").agg(F.max("k").alias("k")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # the range that the head of b also goes to
    ids = np.array(sorted(before), np.int64)
    to = np.array([before[k] for k in sorted(before)], np.int32)

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series) -> pd.Series:
        """Own range, and -1 - range of another where it is borrowed."""
        k = k.to_numpy()
        own = (len(cuts) - np.searchsorted(cuts, k, side="left")).tolist()
        at = np.minimum(np.searchsorted(ids, k), max(len(ids) - 1, 0))
        return pd.Series([[b, -1 - int(to[j])] if ids[j] == x else [b] for b, x, j in zip(own, k.tolist(), at.tolist(), strict=True)])

    placed = rows.withColumn("t", F.explode(targets("k"))).select(F.when(F.col("t") < 0, -1 - F.col("t")).otherwise(F.col("t")).alias("bucket"), (F.col("t") < 0).alias("borrowed"), "doc_id", "text", "k")
    ordered = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "borrowed", F.desc("k"), F.xxhash64("text"), "text")
    return ordered.select("bucket", "borrowed", "doc_id", "text").mapInArrow(_stream, RESULT)
