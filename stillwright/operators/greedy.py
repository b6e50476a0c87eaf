"""Order-dependent selection: greedy clustering, non-maximum suppression, exclusive matching.

Each group is a sorted run of rows inside a partition, folded as it streams by: a task holds what
has been chosen so far, never a whole group. Clusters take a block of a run at a time, and a time gap
alone splits a group into chains of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwright.operators.ranking import carried


def _columns(batch: pa.RecordBatch) -> list:
    """Values of each column; arrays of numbers as the rows of a matrix where all are equally long."""
    out = []
    for c in batch.columns:
        if pa.types.is_list(c.type) and not c.null_count and len(c) and c.flatten().null_count == 0 and len(c.flatten()) % len(c) == 0:
            out.append(c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1))
        else:
            out.append(c.to_pylist())
    return out


def fold(df: DataFrame, keys: list[str], order: list, new_state: Callable, step: Callable, result: str) -> DataFrame:
    """step(state, row dict) -> result tuples, over the rows of each group in the given order."""
    schema = _arrow(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for values in zip(*_columns(batch), strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                mine = tuple(row[k] for k in keys)
                if state is None or mine != key:
                    key, state = mine, new_state()
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k) for k in keys], *order).mapInArrow(run, result)


def fold_runs(df: DataFrame, keys: list[str], order: list, new_state: Callable, place: Callable, result: str) -> DataFrame:
    """place(state, run) -> columns of the result, over the runs of each group in the given order: a run is the part of a
    record batch that belongs to a group, so a group's rows come in runs of up to a batch."""
    schema = _arrow(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [0, *(np.flatnonzero(_changes([batch.column(batch.schema.get_field_index(k)) for k in keys])) + 1).tolist(), batch.num_rows]
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                mine = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
                if state is None or mine != key:
                    key, state = mine, new_state()
                found.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(place(state, part), schema, strict=True)], schema=schema))
            yield from pa.Table.from_batches(found, schema).combine_chunks().to_batches()

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k) for k in keys], *order).mapInArrow(run, result)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's values differ from those of the row before; nulls are equal to each other."""
    out = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out |= codes[1:] != codes[:-1]
    return out


def _arrow(result: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in result.split(", ")])


#: Vectors that are compared with frozen centroids together, at least and at most; how many of a block must be sure for
#: it to be worth its while; what rounding may change.
LEAST_BLOCK, MOST_BLOCK, WORTH, ROUNDING = 8, 1024, 12, 1e-9
#: Rows that are compared with all accepted ones together.
BLOCK = 256


class Clusters:
    """Sums and unit centroids of the clusters so far, in one growing matrix."""

    def __init__(self) -> None:
        self.n = self.steps = self.alone = 0
        self.pause = 1
        self.block = LEAST_BLOCK
        self.sums = self.units = self.norms = None

    def place_all(self, v: np.ndarray, threshold: float) -> np.ndarray:
        """The clusters of rows in order, as `place` gives them one by one.

        A block of rows is compared with the centroids as they are. A vector of length a moves the direction of
        a sum of length s by 2 a / s at most, so as long as the best similarity stays first and on its side of the
        threshold by more than all that the rows before it in the block can have moved, the row goes where it goes
        one by one. The first row for which that isn't sure is placed by itself, and the rest compared anew.
        """
        out, at = np.empty(len(v), np.int64), 0
        lengths = np.linalg.norm(v, axis=1)
        while at < len(v):
            if self.alone:  # blocks have been short: one by one for a while
                out[at] = self.place(v[at], threshold)
                self.alone, at = self.alone - 1, at + 1
                continue
            sure = self._sure(v[at : at + self.block], lengths[at : at + self.block], threshold)
            for c in np.unique(sure).tolist():
                mine = v[at : at + len(sure)][sure == c]
                self._set(c, np.cumsum(np.vstack([self.sums[c], mine]), axis=0)[-1])
            out[at : at + len(sure)] = sure
            at += len(sure)
            if len(sure) == self.block:
                self.block = min(2 * self.block, MOST_BLOCK)
            elif at < len(v):
                out[at] = self.place(v[at], threshold)
                self.block = max(LEAST_BLOCK, min(self.block, 2 * len(sure)))
                self.pause = 1 if len(sure) >= WORTH else min(2 * self.pause, MOST_BLOCK)
                self.alone = self.pause - 1
                at += 1
        return out

    def _sure(self, v: np.ndarray, lengths: np.ndarray, threshold: float) -> np.ndarray:
        """The clusters of the first rows of a block, as far as they are sure."""
        self.steps += 1
        if not self.n:
            return np.empty(0, np.int64)
        near = v @ self.units[: self.n].T
        rows = np.arange(len(v))
        best = near.argmax(axis=1)
        top = near[rows, best]
        # how far each row moves the direction of its own cluster at most, and all rows before one
        left = self.norms[best] - np.cumsum(lengths)
        moved = np.zeros((len(v), self.n))
        moved[rows[1:], best[:-1]] = (2 * lengths / np.where(left > 0, left, 1e-12))[:-1]
        drift = np.cumsum(moved, axis=0, out=moved)
        drift *= lengths[:, None]
        rounding = ROUNDING * np.maximum(lengths, 1)
        least = top - drift[rows, best] - rounding
        near += drift
        near[rows, best] = -np.inf
        sure = (least > near.max(axis=1) + rounding) & (least >= threshold)
        return best[: len(v) if sure.all() else int(sure.argmin())]

    def place(self, v: np.ndarray, threshold: float) -> int:
        self.steps += 1
        if self.sums is None:
            self.sums, self.units, self.norms = np.zeros((16, len(v))), np.zeros((16, len(v))), np.zeros(16)
        if self.n:
            near = self.units[: self.n] @ v
            best = int(near.argmax())  # the first of equals
            if near[best] >= threshold:
                self._set(best, self.sums[best] + v)
                return best
        if self.n == len(self.sums):
            self.sums, self.units, self.norms = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.units, self.norms))
        self.n += 1
        self._set(self.n - 1, v)
        return self.n - 1

    def _set(self, i: int, total: np.ndarray) -> None:
        self.sums[i] = total
        self.norms[i] = float(np.linalg.norm(total))
        self.units[i] = total / max(self.norms[i], 1e-12)


def greedy_clusters(df: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """group, order, cid: each vector, in order, joins the best centroid at or above the threshold or opens the next cluster."""

    def place(state: Clusters, run: pa.RecordBatch) -> list:
        v = run.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(run.num_rows, -1)
        return [run.column(0), run.column(1), state.place_all(v, threshold)]

    narrow = df.select(F.col(group).cast("long").alias(group), F.col(order).cast("long").alias(order), vector)
    return fold_runs(narrow, [group], [F.col(order)], Clusters, place, f"{group} long, {order} long, cid int")


class Accepted:
    """What a group has accepted so far: times in order, hashes in one growing array."""

    def __init__(self) -> None:
        self.n, self.secs, self.hashes = 0, [], np.zeros(16, np.uint64)

    def fits(self, sec: float, gap: float, code: int | None = None, distance: int = 12) -> bool:
        """Whether something is at least `gap` seconds and, if it has a hash, `distance` bits from all accepted."""
        at = bisect_left(self.secs, sec)
        if any(abs(s - sec) < gap for s in self.secs[max(at - 1, 0) : at + 1]):
            return False
        return code is None or not (np.bitwise_count(self.hashes[: self.n] ^ np.uint64(code % 2**64)) < distance).any()

    def add(self, sec: float, code: int | None = None) -> None:
        insort(self.secs, sec)
        if self.n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[self.n] = (code or 0) % 2**64
        self.n += 1

    def take_all(self, secs: np.ndarray, gap: float, codes: np.ndarray | None, distance: int, most: int | None) -> np.ndarray:
        """The places of rows, in order, that are accepted, as `fits` and `add` accept them one by one.

        A block of rows is compared with all that is accepted at once; only rows that pass are looked at one
        by one, against what the block itself has added.
        """
        out: list[int] = []
        for begin in range(0, len(secs), BLOCK):
            at, own = secs[begin : begin + BLOCK], None if codes is None else codes[begin : begin + BLOCK]
            free = np.ones(len(at), bool)
            if self.n and gap > 0:
                held = np.array(self.secs)
                near = np.searchsorted(held, at)
                for k in (near - 1, near):
                    there = (k >= 0) & (k < self.n)
                    free &= ~(there & (np.abs(held[np.clip(k, 0, self.n - 1)] - at) < gap))
            if self.n and own is not None:
                for k in range(0, self.n, BLOCK):
                    free &= ~(np.bitwise_count(own[:, None] ^ self.hashes[None, k : min(k + BLOCK, self.n)]) < distance).any(axis=1)
            before = self.n
            for i in np.flatnonzero(free).tolist():
                if most is not None and self.n >= most:
                    return np.array(out, np.int64)
                if gap > 0 and self.n > before:
                    k = bisect_left(self.secs, at[i])
                    if any(abs(s - at[i]) < gap for s in self.secs[max(k - 1, 0) : k + 1]):
                        continue
                if own is not None and self.n > before and (np.bitwise_count(self.hashes[before : self.n] ^ own[i]) < distance).any():
                    continue
                self.add(float(at[i]), None if own is None else int(own[i]))
                out.append(begin + i)
        return np.array(out, np.int64)


def suppressed(df: DataFrame, group: str, item: str, score: str, sec: str, gap: float, bits: str | None = None, distance: int = 12, most: int | None = None) -> DataFrame:
    """group, item, pick of the items that are accepted: best score first (then least item), at least `gap`
    seconds and, with hashes, `distance` bits from all accepted ones. gap 0 turns the time test off. Rows
    without a time, or without a hash where hashes are given, take no part; those without a score come last.

    Without hashes and a limit, items that `gap` seconds or more part from the ones before them begin a chain of their
    own: nothing of one chain bears on another, so chains are folded apart and a large group is split.
    """
    apart = bits is None and most is None and gap > 0

    def taken(state: Accepted, run: pa.RecordBatch) -> pa.RecordBatch:
        """The accepted rows of a run."""
        secs = run.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False)
        codes = run.column(4).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) if bits else None
        return run.take(pa.array(state.take_all(secs, gap, codes, distance, most)))

    rows = df.select(F.col(group).cast("long").alias(group), F.col(item).cast("long").alias(item), F.col(score).cast("double").alias("_score"), sec, *([bits] if bits else [])).dropna(subset=[sec, *([bits] if bits else [])])
    order = [F.desc("_score"), F.col(item)]
    if not apart:

        def numbered(state: Accepted, run: pa.RecordBatch) -> list:
            before = state.n
            kept = taken(state, run)
            return [kept.column(0), kept.column(1), np.arange(before, state.n, dtype=np.int32)]

        return fold_runs(rows, [group], order, Accepted, numbered, f"{group} long, {item} long, pick int")
    kept = fold_runs(with_chains(rows, group, sec, gap), [group, "_chain"], order, Accepted, lambda state, run: taken(state, run).columns[:3], f"{group} long, {item} long, _score double")
    return kept.select(group, item, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("int").alias("pick"))


def with_chains(df: DataFrame, group: str, sec: str, gap: float) -> DataFrame:
    """df with _chain, the beginning of the chain that a row belongs to: neighbours in time of a chain are less than
    `gap` apart, chains are not. Rows without a time are one chain.

    Rows of a slot of `gap` seconds are one chain; a slot goes on with the one before it, whose last row is read by an
    equi-join, or begins a chain. What beginning each slot has is carried over ranges of slots, so a group is split.
    """
    slot = F.floor(F.col(sec) / gap)
    slots = df.where(F.col(sec).isNotNull()).groupBy(group, slot.alias("_slot")).agg(F.min(sec).alias("_lo"), F.max(sec).alias("_hi"))
    before = slots.select(F.col(group).alias("_g"), (F.col("_slot") + 1).alias("_s"), F.col("_hi").alias("_before"))
    begun = slots.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slot") == F.col("_s")), "left")
    begins = F.when(F.col("_before").isNull() | (F.col("_lo") - F.col("_before") >= gap), F.col("_slot"))
    chained = carried(begun.select(group, "_slot", begins.alias("_chain")), [group], ["_slot"], "_chain").select(F.col(group).alias("_g"), "_slot", "_chain")
    return df.withColumn("_at", slot).join(chained, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_slot")), "left").drop("_g", "_slot", "_at")


def exclusive_matches(specs: DataFrame, candidates: DataFrame, tolerance: int = 10, tier: int = 5, used: DataFrame | None = None) -> DataFrame:
    """work, pos, cid, status: the specs of a work (work, pos, sex, age) take, in order, its best candidate
    (work, cid, sex, age, rank) that is not yet taken, nor in `used` (work, cid).

    Best: the same sex within `tolerance` years, least (years div tier, rank): 'matched'. Else the best
    ranked of the same sex: 'fallback'. Else nothing: 'missing'. A work with k specs needs the k best
    candidates of each only, since the others take k - 1 at most; these are all that comes together.
    """
    if used is not None:
        candidates = candidates.join(used.select("work", "cid"), ["work", "cid"], "left_anti")
    n = Window.partitionBy("work")
    asked = specs.withColumn("_k", F.count(F.lit(1)).over(n))
    years = F.abs(F.col("_age") - F.col("age"))
    far = years > tolerance
    pairs = asked.join(candidates.select("work", "sex", "cid", F.col("age").alias("_age"), "rank"), ["work", "sex"])
    pairs = pairs.select("work", "pos", "_k", far.alias("far"), F.when(far, 0).otherwise(F.floor(years / tier)).cast("int").alias("tier"), "rank", "cid")
    best = Window.partitionBy("work", "pos").orderBy("far", "tier", "rank", "cid")
    most = specs.groupBy("work").count().agg(F.max("count")).first()[0] or 0  # a number, which is applied before the shuffle
    pool = pairs.withColumn("_n", F.row_number().over(best)).where((F.col("_n") <= most) & (F.col("_n") <= F.col("_k")))
    pool = pool.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("pos", "far", "tier", "rank", "cid"))).alias("pool"))
    cast = specs.groupBy("work").agg(F.array_sort(F.collect_list("pos")).alias("asked"))

    def take(acc: Column, pos: Column) -> Column:
        free = F.filter("pool", lambda c: (c["pos"] == pos) & ~F.exists(acc, lambda a: F.coalesce(a["cid"] == c["cid"], F.lit(False))))
        best = F.get(free, F.lit(0))
        status = F.when(best.isNull(), "missing").when(best["far"], "fallback").otherwise("matched")
        return F.concat(acc, F.array(F.struct(pos.cast("int").alias("pos"), best["cid"].alias("cid"), status.alias("status"))))

    empty = F.array().cast("array<struct<pos:int,cid:bigint,status:string>>")
    both = cast.join(pool, "work", "left")
    return both.select("work", F.explode(F.aggregate("asked", empty, take)).alias("m")).select("work", "m.*")


def pinned(pins: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """pos, wanted, key, status of pins (pos, wanted): they name places of the original ranking; what is out
    of range or taken by an earlier pin is reported and gets nothing."""
    first = pins.groupBy("wanted").agg(F.min("pos").alias("_first"))
    j = pins.join(first, "wanted").join(ranked, F.col("wanted") == F.col("rank"), "left")
    status = F.when(F.col(key).isNull(), "out of range").when(F.col("pos") > F.col("_first"), "taken").otherwise("matched")
    return j.select("pos", "wanted", F.when(status == "matched", F.col(key)).alias(key), status.alias("status"))
