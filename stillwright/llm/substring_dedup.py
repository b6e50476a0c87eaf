"""Exact substring dedup by fixed-block anchors.

A window of WINDOW words always contains one whole block of BLOCK words that begins at a multiple
of BLOCK in its document, if WINDOW >= 2 * BLOCK - 1. So the blocks of all documents are indexed,
every rolling BLOCK-word window probes the index, and only the windows around a hit are compared
by their whole word sequence, which extends the hits to maximal repeats.

What is exchanged are packed arrays: a task sends its hashes to each bucket as one row, each
distinct hash once a step of texts, however many of its documents hold it. What is repeated in a
step is remembered by the task and not sent again, so a passage that a third of all documents hold
reaches its bucket about once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import BROADCAST_HASHES, column, materialize, shuffle_partitions, steps, texts
from stillwright.llm.wordhash import Words, byte_class, mix

#: What separates words.
SPACES = b" \t\n\x0b\x0c\r"
INSIDE = byte_class(SPACES)
#: Characters of text whose windows one bucket compares.
BUCKET_CHARS = 16_000_000
#: Hashes that a task remembers at most; beyond it it begins anew.
REMEMBERED = 1_000_000
PROBES = "bucket int, hashes binary, docs binary, counts binary, places binary"
FOUND = "grp int, docs binary, counts binary, places binary"
HITS = "doc_id long, tag long, places binary"
STAGED = "doc_id long, tag long, n_words long, kept_sha256 string, text string, starts binary"


def _grouped(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct owners of a sorted array and how often each occurs."""
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[at], np.diff(np.append(at, len(owner)))


def _packed(bucket: np.ndarray, hashes: list[np.ndarray], widths: list[int], owner: np.ndarray, names: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
    """One row for each bucket: of each hash its low bytes, the documents with their counts, the places.

    names has a row (doc_id, tag) for each document; owner, its places in names, must be sorted; places are
    transposed, so that their high bytes compress.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, owner, places = bucket[order], owner[order], places[order].astype("<u4")
    low = np.concatenate([h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w] for h, w in zip(hashes, widths, strict=True)], axis=1)
    ids, counts = _grouped(bucket)
    at = 0
    for b, n in zip(ids.tolist(), counts.tolist(), strict=True):
        part = slice(at, at + n)
        new = np.flatnonzero(np.append(True, owner[part][1:] != owner[part][:-1]))
        yield b, low[part].tobytes(), names[owner[part][new]].astype("<i8").tobytes(), np.diff(np.append(new, n)).astype("<u4").tobytes(), places[part].view(np.uint8).reshape(-1, 4).T.tobytes()
        at += n


def _named(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents of all rows, (doc_id, tag) each, and of every place the number of its document and the place."""
    if not len(rows):
        return np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
    names = np.frombuffer(b"".join(rows["docs"]), "<i8").reshape(-1, 2)
    own = np.repeat(np.arange(len(names)), np.frombuffer(b"".join(rows["counts"]), "<u4"))
    return names, own, np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1) for x in rows["places"]])


def _unpacked(rows: pd.DataFrame, widths: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents, and the number of its document and the place of each hash, of all rows of a bucket."""
    low = np.frombuffer(b"".join(rows["hashes"]), np.uint8).reshape(-1, sum(widths))
    hashes, at = [], 0
    for w in widths:
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :w] = low[:, at : at + w]
        hashes.append(full.view("<u8").reshape(-1))
        at += w
    return hashes, *_named(rows)


def _by_document(names: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The order that brings the places of a document together."""
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names[:, 1], names[:, 0]))] = np.arange(len(names))
    return np.argsort(rank[own], kind="stable")


def _by_group(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], groups: int) -> pd.DataFrame:
    """What a bucket has found (names, numbers of documents, places), one row for each group of documents."""
    names = np.concatenate([x[0] for x in found])
    own = np.concatenate([x[1] + sum(len(y[0]) for y in found[:i]) for i, x in enumerate(found)])
    places = np.concatenate([x[2] for x in found])
    order = _by_document(names, own)
    own, places = own[order], places[order]
    grp = (mix((names[own, 0] ^ names[own, 1]).view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    rows = list(_packed(grp, [np.zeros(len(own), np.uint64)], [0], own, names, places)) if len(own) else []
    return pd.DataFrame([(g, *rest) for g, _, *rest in rows], columns=["grp", "docs", "counts", "places"])


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a group: all places that any bucket has found."""
    names, own, places = _named(rows)
    order = _by_document(names, own)
    names, places = names[own[order]], places[order].astype("<u4")
    new = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1)))
    ends = np.append(new[1:], len(names))
    return pd.DataFrame({"doc_id": names[new, 0], "tag": names[new, 1], "places": [places[a:b].tobytes() for a, b in zip(new.tolist(), ends.tolist(), strict=True)]})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PROBES.split(", ")])


def _local(owner: np.ndarray, names: np.ndarray, places: np.ndarray, bucket: int) -> list[tuple]:
    """A row of hits that need no other task; it has no hashes."""
    if not len(owner):
        return []
    order = np.argsort(owner, kind="stable")
    (row,) = _packed(np.zeros(len(owner), np.int64), [np.zeros(len(owner), np.uint64)], [0], owner[order], names, places[order])
    return [(bucket, b"", *row[2:])]


def _names(part: pa.RecordBatch) -> np.ndarray:
    """(doc_id, tag) of each row; without tags all are 0."""
    ids = column(part, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([ids, column(part, "tag").to_numpy() if "tag" in part.schema.names else np.zeros(len(ids), np.int64)], axis=1)


class Remembered:
    """Repeated hashes (with a second hash and a number each) that a task has sent already, sorted."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most = most
        self.hashes, self.checks, self.numbers = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each is, and whether it is there."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == hashes) & (self.checks[at] == checks) if len(self.hashes) else np.zeros(len(hashes), bool)

    def add(self, hashes: np.ndarray, checks: np.ndarray, numbers: np.ndarray) -> None:
        if len(hashes) + len(self.hashes) > self.most:
            self.__init__(self.most)
        all_ = np.concatenate([self.hashes, hashes[: self.most]])
        _, first = np.unique(all_, return_index=True)
        self.hashes, self.checks, self.numbers = all_[first], np.concatenate([self.checks, checks[: self.most]])[first], np.concatenate([self.numbers, numbers[: self.most]])[first]


class Dedup:
    """The stages; window and block in words, buckets the number of groups that hashes fall into."""

    def __init__(self, window: int, block: int, buckets: int) -> None:
        if window < 2 * block - 1:
            raise ValueError("a window must be long enough to contain a whole block: window >= 2 * block - 1")
        self.window, self.block, self.buckets = window, block, buckets

    @staticmethod
    def exchanged(rows: DataFrame, send, compare) -> DataFrame:
        """Hashes to their buckets, and what is found there back to one row a document."""
        return rows.mapInArrow(send, PROBES).groupBy("bucket").applyInPandas(lambda found: compare(found), FOUND).groupBy("grp").applyInPandas(_merged, HITS)

    def probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rolling hashes of documents with at least one window, each once a document; aligned blocks are marked by the low bit of a place."""
        sent = Remembered()
        for number, part in enumerate(steps(batches)):
            names = _names(part)
            words = Words([x.encode() for x in column(part, "text").to_pylist()], INSIDE)
            at, h = words.windows(self.block)
            owner = words.owner()[at]
            long_enough = words.counts[owner] >= self.window
            at, h, owner = at[long_enough], h[long_enough], owner[long_enough]
            if not len(at):
                continue
            place = at - words.bounds[owner]
            mark = (place % self.block == 0).astype(np.int64)
            # equal hashes of a document become one, marked if any of them is aligned
            order = np.lexsort((1 - mark, owner, h))
            first = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
            order = order[first]
            h, owner, place, mark = h[order], owner[order], place[order], mark[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            times = np.diff(np.append(new, len(h)))
            marked = np.add.reduceat(mark, new)
            # known here: several documents and an aligned block among them, or very many documents
            _, again = sent.find(h[new], np.zeros(len(new), np.uint64))
            fresh = (times > 1) & ((marked > 0) | (times > 8)) & ~again
            # what this task has sent with a mark needs no more sending: all who hold it know that they are hit
            kept = fresh & (marked > 0)
            sent.add(h[new][kept], np.zeros(int(kept.sum()), np.uint64), np.zeros(int(kept.sum()), np.int64))
            known = np.repeat(fresh | again, times)
            lead = np.zeros(len(h), bool)
            lead[new[~again]] = True
            send = ~known | lead
            coded = place * 2 + np.where(known, np.repeat(marked > 0, times), mark)
            rows = _local(owner[known], names, place[known] * 2, number % self.buckets)
            order = np.flatnonzero(send)
            order = order[np.argsort(owner[order], kind="stable")]
            bucket = ((h[order] >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
            yield _batch(rows + list(_packed(bucket, [h[order]], [5], owner[order], names, coded[order])))

    def hits(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Places whose block hash is that of an aligned block elsewhere, or of one that others probe."""
        local = rows["hashes"].str.len() == 0
        (h,), names, own, coded = _unpacked(rows[~local], [5])
        order = np.argsort(h, kind="stable")
        h, own, coded = h[order], own[order], coded[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        times = np.diff(np.append(new, len(h)))
        mark = (coded & 1).astype(np.int64)
        marked = np.repeat(np.add.reduceat(mark, new), times) if len(h) else mark
        hit = (marked - mark > 0) | (mark > 0) & (np.repeat(times, times) > 1)
        known, mine, places = _named(rows[local])
        return _by_group([(known, mine, places >> 1), (names, own[hit], coded[hit] >> 1)], self.buckets)

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without hits are done; the others go on with the windows around their hits."""
        for part in steps(batches):
            block = [x.encode() for x in column(part, "text").to_pylist()]
            words = Words(block, INSIDE)
            _, h = words.windows(self.block)
            rows = []
            begin = 0
            for i, (doc, tag, found) in enumerate(zip(*(column(part, c).to_pylist() for c in ("doc_id", "tag", "hits")), strict=True)):
                n = int(words.counts[i])
                mine = h[begin : begin + max(n - self.block + 1, 0)]
                begin += len(mine)
                starts = self._around(mine, n, found or b"")
                if len(starts):
                    rows.append((doc, tag, n, None, block[i].decode(), starts.astype("<u4").tobytes()))
                else:
                    rows.append((doc, tag, n, self._digest(words, i, None), None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in STAGED.split(", ")])

    def _around(self, hashes: np.ndarray, n: int, found: bytes) -> np.ndarray:
        """First words of the windows that contain a block like one of those found."""
        places = np.frombuffer(found, "<u4").astype(np.int64)
        places = places[places < len(hashes)]
        if not len(places):
            return places
        hit = np.isin(hashes, hashes[places])
        seen = np.cumsum(np.append(0, hit))
        starts = np.arange(n - self.window + 1)
        span = self.window - self.block + 1
        return starts[seen[starts + span] > seen[starts]]

    @staticmethod
    def _digest(words: Words, i: int, gone: np.ndarray | None) -> str:
        at = np.arange(words.bounds[i], words.bounds[i + 1])
        if gone is not None:
            at = at[~gone]
        cut = words.buffer
        return hashlib.sha256(b" ".join([cut[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])).hexdigest()

    def windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole-sequence hashes of the windows in question, of each step only the smallest document's, and
        only if no earlier step of the task has sent those of a smaller one."""
        sent = Remembered()
        for number, part in enumerate(steps(batches)):
            names = _names(part)
            words = Words([x.encode() for x in column(part, "text").to_pylist()], INSIDE)
            at, h = words.windows(self.window)
            _, check = words.windows(self.window, seed=1)
            starts = [np.frombuffer(x, "<u4").astype(np.int64) for x in column(part, "starts").to_pylist()]
            owner = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
            place = np.concatenate(starts)
            pick = np.searchsorted(at, place + words.bounds[owner])
            h, check, docs = h[pick], check[pick] & np.uint64(0xFFFFFFFF), names[owner, 0]
            order = np.lexsort((place, docs, check, h))
            h, check, docs, owner, place = h[order], check[order], docs[order], owner[order], place[order]
            new = np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]))
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            least, most = docs[begin], docs[np.append(begin[1:], len(docs)) - 1]
            where, there = sent.find(h[begin], check[begin])
            if there.any():
                least[there] = np.minimum(least[there], sent.numbers[where[there]])
                sent.numbers[where[there]] = least[there]
            repeated = (most > least) & ~there
            sent.add(h[begin][repeated], check[begin][repeated], least[repeated])
            gone = docs > least[group]
            rows = _local(owner[gone], names, place[gone], number % self.buckets)
            # of the smallest document every place goes, for all are removed if a smaller one turns up
            keep = np.flatnonzero(~gone)
            keep = keep[np.argsort(owner[keep], kind="stable")]
            bucket = ((h[keep] >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
            yield _batch(rows + list(_packed(bucket, [h[keep], check[keep]], [8, 4], owner[keep], names, place[keep])))

    def removed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """First words of the windows that a smaller document also has."""
        local = rows["hashes"].str.len() == 0
        (h, check), names, own, at = _unpacked(rows[~local], [8, 4])
        order = np.lexsort((names[own, 0], check, h))
        h, check, own, at = h[order], check[order], own[order], at[order]
        docs = names[own, 0]
        new = np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])) if len(h) else np.empty(0, bool)
        gone = docs > docs[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else new
        return _by_group([_named(rows[local]), (names, own[gone], at[gone])], self.buckets)

    def finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            words = Words([x.encode() for x in column(part, "text").to_pylist()], INSIDE)
            rows = []
            for i, (doc, found) in enumerate(zip(column(part, "doc_id").to_pylist(), column(part, "hits").to_pylist(), strict=True)):
                n = int(words.counts[i])
                places = np.frombuffer(found or b"", "<u4").astype(np.int64)
                places = places[places + self.window <= n]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, places, 1)
                np.add.at(edge, places + self.window, -1)
                gone = np.cumsum(edge[:n]) > 0
                rows.append((doc, n, int(gone.sum()), self._digest(words, i, gone)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def tagged(rows: DataFrame) -> DataFrame:
    """The rows with a tag that tells apart different texts of one doc_id: a hash of the text for ids that have
    several, 0 for all others. Found by two combinable aggregates on hashes."""
    named = rows.select("doc_id", F.xxhash64("text").alias("h"))
    shared = named.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("doc_id", F.lit(True).alias("shared"))
    shared = materialize(shared, "shared", free=False)
    n = shared.count()
    if not n:
        return rows.withColumn("tag", F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(shared) if n <= BROADCAST_HASHES else shared, "doc_id", "left")
    return rows.select("doc_id", "text", F.when(F.col("shared"), F.xxhash64("text").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")).alias("tag"))


def remove_repeats(docs: DataFrame, window: int = 13, block: int = 7, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 after removing every word that is in a window whose
    word sequence also starts in a document with a smaller doc_id.

    Words are runs of anything but ASCII white space, unchanged. Null and empty texts have no words
    (the digest is that of the empty text); texts shorter than a window lose nothing. A null
    doc_id is smaller than none and greater than none: its text stays whole and removes nothing. Rows
    of one doc_id don't remove from each other, whether their texts are equal or not; each loses its own words only.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(chars // bucket_chars) + 1)
    job = Dedup(window, block, buckets)
    known = tagged(rows.where("doc_id is not null"))
    hits = materialize(job.exchanged(known, job.probes, job.hits), "hits").withColumnRenamed("places", "hits")
    # rows without an id have no hits: they stay out of the join, where they would meet in one task
    nameless = rows.where("doc_id is null").withColumns({"tag": F.lit(0).cast("long"), "hits": F.lit(None).cast("binary")})
    staged = materialize(known.join(hits, ["doc_id", "tag"], "left").unionByName(nameless).mapInArrow(job.stage, STAGED), "staged")
    done = staged.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    pending = staged.where("text is not null").select("doc_id", "tag", "text", "starts")
    gone = materialize(job.exchanged(pending, job.windows, job.removed), "gone").withColumnRenamed("places", "hits")
    rest = pending.drop("starts").join(gone, ["doc_id", "tag"], "left").mapInArrow(job.finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return done.unionByName(rest)
