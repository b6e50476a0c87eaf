"""Best-fit packing by patterns: non-negative least squares on the histogram of lengths.

The plan is made from the histogram alone (at most max_tokens numbers, however many documents
there are), so the driver's work and what is sent to the tasks are bounded by parameters:

1. lengths fall into classes of equal token mass; patterns are the few-document multisets of classes
   whose mean lengths fill a sequence; NNLS fits how often to use each; rounded down, they are filled
   with real lengths that leave (almost) no room; what is left is fitted once more;
2. the rest, and the shortest documents, which were held back for it, are packed best-fit on counts
   of equal lengths.

A document finds its place by its rank among the pieces of its length; the ranks come from
counts per task, so one frequent length never meets in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwright.llm.array_bpe import ArrayBPE
from stillwright.llm.common import column, materialize, steps, texts

MEMORY = 400_000
#: Shapes of plans: length classes, documents of a pattern at most, tokens that a pattern's sequence may leave
#: empty. The first whose plan needs no more sequences than the tokens do is used, or the one with fewest.
SHAPES = ((24, 6, 8), (24, 6, 0), (16, 6, 0), (12, 4, 0))
#: Share of all tokens that is held back for the gaps, shortest documents first; share of a sequence that the
#: means of a pattern may fall short of it; fits of what earlier ones have left.
HELD_BACK, SHORT, FITS = 0.01, 0.01, 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int"


class Recent:
    """Values of keys that were asked for lately: when the newer of two parts holds half of `most`, the older goes."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that have no value yet; all others are in `new` now."""
        if len(self.new) > self.most // 2:
            self.old, self.new = self.new, {}
        keys = keys - self.new.keys()
        held = keys & self.old.keys()
        self.new.update((k, self.old[k]) for k in held)
        return keys - held


class WordIds:
    """Token ids of texts for a tokenizer whose pre-tokens never reach across white space.

    What stands between white space is encoded once and remembered as the bytes of its ids. Plain
    Latin words are merged in arrays, all new ones of a step together; others go to the library.
    """

    #: White space of the tokenizer's pattern; str.split() also takes \\x1c-\\x1f.
    space = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
    odd = regex.compile("[\\x1c-\\x1f]")
    #: Words of these characters are in composed form, and Python lowers them as the library does.
    plain = regex.compile("[!-~\\xa1-\\u012f\\u0132-\\u017f]+")
    #: The pattern that splits a word before the merges.
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bpe = Tokenizer.from_file(path), ArrayBPE(path)
        self.known, self.parts = Recent(memory), Recent(memory // 2)

    def _learn(self, words: set[str]) -> None:
        # letters alone, or before one other sign, need no search
        letters = [w for w in words if w.isalpha() and w.isascii()]
        rest = words.difference(letters)
        ended = [w for w in rest if w.isascii() and w[:-1].isalpha() and not w[-1].isalnum() and "!" <= w[-1] <= "~"]
        rest.difference_update(ended)
        simple = [w for w in rest if self.plain.fullmatch(w) and "<|" not in w]
        low, heads, tails = list(map(str.lower, letters)), [w[:-1].lower() for w in ended], [w[-1] for w in ended]
        parts = [self.pattern.findall(w.lower()) for w in simple]
        fresh = list(self.parts.missing({*low, *heads, *tails, *chain.from_iterable(parts)}))
        self.parts.new.update(zip(fresh, self.bpe.encode([p.encode() for p in fresh]), strict=True))
        of, new = self.parts.new.__getitem__, self.known.new
        new.update(zip(letters, map(of, low), strict=True))
        new.update(zip(ended, map(add, map(of, heads), map(of, tails)), strict=True))
        new.update((w, b"".join(map(of, ps))) for w, ps in zip(simple, parts, strict=True))
        if others := list(rest.difference(simple)):
            found = self.tokenizer.encode_batch(others, add_special_tokens=False)
            new.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, found, strict=True))

    def encode(self, block: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [[w for w in self.space.split(t) if w] if self.odd.search(t) else t.split() for t in block]
        self._learn(self.known.missing(set().union(*split)))
        get = self.known.new.__getitem__
        return (b"".join(map(get, words)) for words in split)


@lru_cache(maxsize=1)
def word_ids(path: str, memory: int) -> WordIds:
    """What a worker keeps from task to task."""
    return WordIds(path, memory)


def pieces(docs: DataFrame, path: str, max_tokens: int, end_id: int, memory: int = MEMORY) -> DataFrame:
    """Pieces of each document's ids plus end_id: doc_id, piece, start, length, ids_crc32, task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, words, most = TaskContext.get().partitionId(), word_ids(path, memory), 4 * max_tokens
        for part in steps(batches):
            rows: list[tuple] = []
            for doc, ids in zip(column(part, "doc_id").to_pylist(), words.encode(column(part, "text").to_pylist()), strict=True):
                ids += end
                rows += ((doc, at // most, at // 4, min(most, len(ids) - at) // 4, zlib.crc32(ids[at : at + most]), task) for at in range(0, len(ids), most))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - b| over x >= 0, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, slope = a.T @ a, a.T @ b
    target = slope.copy()
    gram[np.diag_indices_from(gram)] += 1e-10
    least = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= least:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.solve(gram[np.ix_(at, at)], target[at])
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            gone = at[low & (x[at] <= 1e-9)]
            gone = gone if len(gone) else at[low][:1]
            x[gone], free[gone] = 0, False
        slope = target - gram @ x
    return x


def patterns(means: list[float], size: int, most: int, short: float) -> list[tuple[int, ...]]:
    """Multisets of 2 to `most` classes, in descending order, whose means sum to `size` or up to `short` less."""
    out: list[tuple[int, ...]] = []

    def grow(left: float, top: int, got: tuple[int, ...]) -> None:
        if len(got) > 1 and left <= short:
            out.append(got)
        if len(got) < most:
            for c in range(min(top, bisect_right(means, left) - 1), -1, -1):
                if left - means[c] * (most - len(got)) > short:
                    break
                grow(left - means[c], c, (*got, c))

    grow(float(size), len(means) - 1, ())
    return out


class Plan:
    """Groups of equal sequences: their contents as (length, copies) runs, and how many of them."""

    def __init__(self, histogram: dict[int, int], max_tokens: int, classes: int, most: int, gap: int) -> None:
        """classes: of lengths; most: documents of a pattern at most; gap: tokens that its sequences may leave empty."""
        self.size = max_tokens
        self.left = {n: c for n, c in histogram.items() if c}
        self.open: list[tuple[int, int]] = []  # (room, group), sorted
        self.content: list[list[tuple[int, int]]] = []
        self.times: list[int] = []
        self.patterned = 0  # pieces that patterns have placed
        short = sum(n * c for n, c in self.left.items()) * HELD_BACK
        for _ in range(FITS):
            before = self.patterned
            self._fit(classes, most, gap, short)
            if self.patterned == before:
                break
        self._best_fit()

    def _add(self, content: list[tuple[int, int]], times: int) -> None:
        room = self.size - sum(n * k for n, k in content)
        self.content.append(content)
        self.times.append(times)
        if room:
            insort(self.open, (room, len(self.content) - 1))

    def _fit(self, classes: int, most: int, gap: int, held_back: float) -> None:
        """Fit patterns to the lengths that are left, without full sequences and the shortest documents of
        `held_back` tokens together, and fill them."""
        lengths = np.array(sorted(n for n, c in self.left.items() if c and n < self.size), np.int64)
        counts = np.array([self.left[n] for n in lengths.tolist()], np.int64)
        used = np.cumsum(lengths * counts) > held_back
        lengths, counts = lengths[used], counts[used]
        if not len(lengths):
            return
        mass = np.cumsum(lengths * counts) - lengths * counts / 2
        classes = max(2, min(classes, int(counts.sum()) // 32))  # a fit to a few documents has few classes
        of = (mass * classes / (lengths * counts).sum()).astype(np.int64)
        parts = [of == c for c in np.unique(of)]
        stock = [lengths[x].tolist() for x in parts]
        held = np.array([counts[x].sum() for x in parts], float)
        means = [float((lengths[x] * counts[x]).sum() / counts[x].sum()) for x in parts]
        kinds = patterns(means, self.size, most, SHORT * self.size)
        if not kinds:
            return
        a = np.zeros((len(parts), len(kinds)))
        for j, kind in enumerate(kinds):
            for c in kind:
                a[c, j] += 1
        weight = np.array(means) / self.size  # what is left over counts by its tokens
        repeats = np.floor(nnls(a * weight[:, None], held * weight) + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j]:
                self._fill(kinds[j], int(repeats[j]), stock, means, gap)

    def _fill(self, kind: tuple[int, ...], repeat: int, stock: list[list[int]], means: list[float], gap: int) -> None:
        """Use a pattern `repeat` times or as long as lengths of its classes fill a sequence but for `gap`."""
        while repeat and (taken := self._filling(kind, stock, means, gap)):
            times = min(repeat, *(self.left[n] // taken.count(n) for n in taken))
            for n in taken:
                self.left[n] -= times
            for c in set(kind):
                stock[c] = [n for n in stock[c] if self.left[n]]
            self._add([(n, 1) for n in taken], times)
            self.patterned += len(taken) * times
            repeat -= times

    def _free(self, lengths: list[int], k: int, step: int, taken: list[int]) -> int | None:
        """The length at k, or the next one in steps, of which some are left beyond those taken."""
        while 0 <= k < len(lengths):
            if self.left[lengths[k]] > taken.count(lengths[k]):
                return lengths[k]
            k += step
        return None

    def _filling(self, kind: tuple[int, ...], stock: list[list[int]], means: list[float], gap: int) -> list[int]:
        """Lengths of a pattern's classes: the longest one, then what leaves the others about their means;
        the last two are chosen together so that least room is left. Empty if that is more than `gap`."""
        taken: list[int] = []
        room, rest = self.size, sum(means[c] for c in kind)
        for c in kind[:-2]:
            rest -= means[c]
            at = bisect_right(stock[c], room - rest) if taken else len(stock[c])
            n = self._free(stock[c], at - 1, -1, taken) or self._free(stock[c], at, 1, taken)
            if n is None:
                return []
            taken.append(n)
            room -= n
        best = (gap + 1, 0, 0)
        for n in reversed(stock[kind[-2]]):
            if self.left[n] > taken.count(n) and n < room:
                m = self._free(stock[kind[-1]], bisect_right(stock[kind[-1]], room - n) - 1, -1, [*taken, n])
                if m and room - n - m < best[0]:
                    best = (room - n - m, n, m)
                    if not best[0]:
                        break
        return [*taken, *best[1:]] if best[0] <= gap else []

    def _best_fit(self) -> None:
        """Longest first, each where the least room that holds it is left; equal ones at once."""
        for n in sorted(self.left, reverse=True):
            count = self.left[n]
            while count:
                at = bisect_left(self.open, (n, -1))
                if at < len(self.open):
                    room, group = self.open.pop(at)
                    each = min(room // n, count)
                    times = min(self.times[group], count // each)
                    if times < self.times[group]:
                        self.times[group] -= times
                        insort(self.open, (room, group))
                    else:
                        self.times[group] = 0
                    self._add([*self.content[group], (n, each)], times)
                    count -= each * times
                elif count >= (each := self.size // n):
                    self._add([(n, each)], count // each)
                    count %= each
                else:
                    self._add([(n, count)], 1)
                    count = 0

    @property
    def sequences(self) -> int:
        return sum(self.times)

    def slots(self) -> dict[str, np.ndarray]:
        """Ranges of ranks: pieces of `length` with rank in [rank, rank + copies * times) go, `copies`
        to each sequence from `sequence` on, to places from `offset` on."""
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for content, times in zip(self.content, self.times, strict=True):
            if not times:
                continue
            offset = 0
            for n, copies in content:
                rows.append((n, rank.get(n, 0), copies, sequence, offset))
                rank[n] = rank.get(n, 0) + copies * times
                offset += n * copies
            sequence += times
        rows.sort()
        names = ("length", "rank", "copies", "sequence", "offset")
        return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def best_plan(histogram: dict[int, int], max_tokens: int, shapes: tuple = SHAPES) -> Plan:
    """The first plan that needs as few sequences as the tokens need at least, or the one with fewest."""
    least = -(-sum(n * c for n, c in histogram.items()) // max_tokens)
    best: Plan | None = None
    for shape in shapes:
        plan = Plan(histogram, max_tokens, *shape)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= least:
            break
    return best


def ranked(df: DataFrame) -> DataFrame:
    """rank: from 0 among the rows of a length. First within (length, task), then by the tasks' counts."""
    inside = Window.partitionBy("length", "task").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("length", "task").count().select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return df.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["length", "task"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "task")


def pack(docs: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 1, shapes: tuple = SHAPES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts are one piece, the end id alone. Repeated rows are packed each for itself
    (equal ids and pieces of them get different places). An empty table gives an empty result.
    Only longer documents are cut. Other columns are not read. To the driver comes the histogram
    (at most max_tokens rows); to the tasks goes the plan, whose size depends on the parameters only.
    """
    parts = materialize(pieces(docs, path, max_tokens, end_id), "pieces", free=False)
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    plan = best_plan(histogram, max_tokens, shapes).slots()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan["length"] << 40 | plan["rank"]
        for batch in batches:
            length, rank = (column(batch, c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            more, copies = rank - plan["rank"][at], plan["copies"][at]
            added = {"sequence_id": plan["sequence"][at] + more // copies, "offset": plan["offset"][at] + more % copies * length}
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [pa.array(x) for x in added.values()], names=[*kept, *added])

    return ranked(parts).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
