"""Hard negatives by a full score sort for each anchor.

Vectors become integers, so scores and limits are exact. The table is packed into blocks, the anchors
(a stated share of the rows) into chunks, and every block meets every chunk: one matrix product, one
lexsort by score and id for each anchor of the chunk. A first pass reads each anchor's best rows of its
own label; a second one binary-searches the upper limit of each of these positives among the rows of
other labels and reads on from there while the lower limit holds. A block gives a few rows for each
anchor; the first of all blocks' are the first of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwright.llm.common import column, materialize

#: Rows of a block, anchors of a chunk, bytes of chunks that go to every task at most.
BLOCK_ROWS, CHUNK_ROWS, BROADCAST_BYTES = 8192, 1024, 32_000_000
#: Bound that integer sums keep exact in a float32 and a float64 product.
EXACT_32, EXACT_64 = 2.0**24, 2.0**53
PACKED = "dim int, ids binary, labels binary, keys binary, vectors binary, most double"
ANCHORS = f"{PACKED}, positives binary, scores binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key, embedding of the rows that take part; key tells rows of one vec_id apart."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd))
    return rows.withColumn("key", F.xxhash64("label", "embedding"))


def integers(values: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each length of vectors the rows that have it and floor(256 * x) of their components."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(values.offsets.to_numpy())
    begins = np.cumsum(lens) - lens
    out = []
    for dim in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == dim)
        out.append((rows, np.floor(256 * flat[begins[rows][:, None] + np.arange(dim)])))
    return out


def _record(ids: np.ndarray, labels: np.ndarray, keys: np.ndarray, vectors: np.ndarray, *rest: np.ndarray) -> tuple:
    """A packed row; equal rows are there once, in the order of their ids."""
    order = np.lexsort((keys, ids))
    order = order[np.append(True, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1]))]
    most = float(np.abs(vectors).max(initial=0.0))
    kind = "<i2" if most < 2**15 else "<f8"
    return (vectors.shape[1], ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(), keys[order].astype("<i8").tobytes(), vectors[order].astype(kind).tobytes(), most, *(x[order].astype("<i8").tobytes() for x in rest))


def _batch(records: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 4, pa.float64(), *[pa.binary()] * (len(records[0]) - 6))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ANCHORS.split(", ")][: len(kinds)])


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """The table as packed rows of at most `size` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            return _batch([_record(*(np.concatenate(x) for x in zip(*held.pop(dim), strict=True)))])

        for batch in batches:
            ids, labels, keys = (column(batch, c).to_numpy() for c in ("vec_id", "label", "key"))
            for at, vectors in integers(column(batch, "embedding")):
                dim = vectors.shape[1]
                for begin in range(0, len(at), size):
                    part = at[begin : begin + size]
                    if sum(len(x[0]) for x in held.get(dim, ())) + len(part) > size:
                        yield packed(dim)
                    held.setdefault(dim, []).append((ids[part], labels[part], keys[part], vectors[begin : begin + size]))
        for dim in list(held):
            yield packed(dim)

    return rows.mapInArrow(run, PACKED)


def chunks(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors in n chunks, each a few packed rows with the ids and scores of its positives."""

    def pack(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        number, ids, labels, keys = (column(batch, c).to_numpy() for c in ("chunk", "vec_id", "label", "key"))
        best = [np.array(column(batch, c).to_pylist(), object) for c in ("positives", "scores")]
        made = []
        for at, vectors in integers(column(batch, "embedding")):
            # arrays of one length each, filled with 0; how many are real is the first number
            wide = [np.array([[len(x), *x, *[0] * (width - len(x))] for x in (list(b[i]) for i in at)], np.int64) for b in best for width in [max(len(b[i]) for i in at)]]
            made.append(_record(ids[at], labels[at], keys[at], vectors, *wide))
        out = pa.Table.from_batches([_batch(made)])
        return out.add_column(0, "chunk", pa.array([int(number[0])] * len(made), pa.int32()))

    keyed = anchors.withColumn("chunk", F.expr(f"cast(pmod(xxhash64(vec_id, key), {n}) as int)"))
    return keyed.groupBy("chunk").applyInArrow(pack, f"chunk int, {ANCHORS}")


def together(blocks_: DataFrame, anchors: DataFrame, chunk_rows: int, broadcast_bytes: int) -> DataFrame:
    """Every block beside every chunk. A few chunks (what they can have in bytes is known from the anchors' number and
    lengths) go to every task; more meet the blocks by number and a share of the blocks, so that a chunk is no hot key."""
    rows, components, held = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.coalesce(F.max(F.size("positives")), F.lit(0))).first()
    n = max(1, -(-rows // chunk_rows))
    chunked = chunks(anchors, n)
    chunked = chunked.select("chunk", *(F.col(x.split()[0]).alias(f"a_{x.split()[0]}") for x in ANCHORS.split(", ")))
    every = blocks_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if 8 * (components + rows * (3 + 2 * (held + 1))) <= broadcast_bytes:
        return every.join(F.broadcast(chunked), "chunk")
    shares = max(1, -(-4 * int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n))
    every = every.withColumn("share", F.expr(f"cast(pmod(xxhash64(ids), {shares}) as int)"))
    return every.join(chunked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), ["chunk", "share"])


class Pair:
    """A block and a chunk: integer scores and, by anchor, the places of the block by falling score and rising id."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind="<i8": np.frombuffer(row[name], kind)
        self.ids, self.labels, self.keys = read("ids"), read("labels"), read("keys")
        self.a_ids, self.a_labels, self.a_keys = read("a_ids"), read("a_labels"), read("a_keys")
        # the first number of each line says how many positives there are
        self.positives, self.limits = (x.reshape(len(self.a_ids), -1) for x in (read("a_positives"), read("a_scores")))
        mine, others = (read(f"{p}vectors", "<i2" if row[f"{p}most"] < 2**15 else "<f8").reshape(len(n), row["dim"]) for p, n in (("a_", self.a_ids), ("", self.ids)))
        self.scores = products(mine, others, row["most"] * row["a_most"] * row["dim"])
        place = np.broadcast_to(np.arange(len(self.ids)), self.scores.shape)
        self.order = np.lexsort((place, -self.scores), axis=1)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products; no sum of them is beyond bound. Those beyond 64 bits are an error."""
    if bound < EXACT_64:
        kind = np.float32 if bound < EXACT_32 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in line] for line in x.tolist()], object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    return np.array(exact.tolist(), np.int64).reshape(len(a), len(b))


BEST = "anchor_id long, anchor_key long, vec_id long, key long, score long"


def _same_label(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != row["a_dim"]:
                    continue
                p = Pair(row)
                a, b = [], []
                for i, line in enumerate(p.order):
                    best = line[p.labels[line] == p.a_labels[i]][: most + 1]
                    best = best[(p.ids[best] != p.a_ids[i]) | (p.keys[best] != p.a_keys[i])][:most]
                    a.append(np.full(len(best), i))
                    b.append(best)
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.a_ids[a], p.a_keys[a], p.ids[b], p.keys[b], p.scores[a, b])], names=[x.split()[0] for x in BEST.split(", ")])

    return run


FOUND = "anchor_id long, anchor_key long, place int, positive_id long, positive_score long, negative_id long, negative_key long, negative_score long"


def _other_labels(most: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != row["a_dim"]:
                    continue
                p = Pair(row)
                a, place, b = [], [], []
                for i, line in enumerate(p.order):
                    others = line[p.labels[line] != p.a_labels[i]]
                    falling = -p.scores[i, others]
                    for j, limit in enumerate(p.limits[i, 1 : 1 + p.limits[i, 0]].tolist()):
                        # low * limit <= high * score <= high * limit, in whole numbers
                        least = -(-low * limit // high)
                        begin = np.searchsorted(falling, -limit, "left")
                        best = others[begin : begin + most]
                        best = best[p.scores[i, best] >= least]
                        a.append(np.full(len(best), i))
                        place.append(np.full(len(best), j, np.int32))
                        b.append(best)
                a, place, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, place, b))
                found = (p.a_ids[a], p.a_keys[a], place.astype(np.int32), p.positives[a, 1 + place], p.limits[a, 1 + place], p.ids[b], p.keys[b], p.scores[a, b])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _first(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group, equal rows once; each task sends its own first ones only."""
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.dropDuplicates([*group, "rank"])


def hard_negatives(
    vectors: DataFrame, anchors_each: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by anchors_each. An anchor's positives are its first
    other rows of its label, by falling score, then by vec_id; a positive's negatives the first rows of
    other labels with low * positive_score <= high * negative_score <= high * positive_score.

    Rows with a null vec_id, label, vector or component, or one that is not finite, take no part. Rows that
    repeat vec_id, label and vector count once; rows that share a vec_id only are rows of their own (also as
    anchors and as positives of each other), in the order of a hash where they tie. Vectors of different lengths have
    no score; empty vectors have the score 0 with each other. A score beyond 64 bits is an error. An anchor
    without positives and a positive without negatives give no row, so an empty table gives an empty result.
    Other columns are not read.
    """
    rows = usable(vectors)
    packed = materialize(blocks(rows, block_rows), "blocks", free=False)
    none = F.lit(None).cast("array<long>")
    anchors = materialize(rows.where(F.col("vec_id") % anchors_each == 0).dropDuplicates(["vec_id", "key"]), "anchors", free=False)
    met = together(packed, anchors.withColumn("positives", F.coalesce(none, F.array().cast("array<long>"))).withColumn("scores", F.col("positives")), chunk_rows, broadcast_bytes)
    best = _first(met.mapInArrow(_same_label(positives), BEST), ["anchor_id", "anchor_key"], [F.desc("score"), "vec_id", "key"], positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    known = materialize(anchors.join(best, ["vec_id", "key"]).select("vec_id", "key", "label", "embedding", F.col("best.vec_id").alias("positives"), F.col("best.score").alias("scores")), "positives", free=False)
    met = together(packed, known, chunk_rows, broadcast_bytes)
    found = _first(met.mapInArrow(_other_labels(negatives, low, high), FOUND), ["anchor_id", "anchor_key", "place"], [F.desc("negative_score"), "negative_id", "negative_key"], negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, each: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, embedding, the label moved on by one where vec_id is divisible by `each`."""
    moved = F.when(vectors["vec_id"] % each == 0, (vectors["label"].cast("long") + 1) % labels).otherwise(vectors["label"].cast("long"))
    return vectors.select(vectors["vec_id"], moved.alias("label"), vectors["embedding"])
