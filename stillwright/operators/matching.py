"""Joins by nearness, similarity, prefix and precedence."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwright.functions.vectors import hamming
from stillwright.operators.ranking import carried, checkpointed

#: Bytes of centroids that go to every task at most, and that a block has beyond it; items of a chunk.
BROADCAST_BYTES, CHUNK = 32_000_000, 20_000
#: Crowded values of hash parts that go to every task at most.
BROADCAST_PARTS = 100_000
#: Values of a part that one hash asks for at most.
MOST_KEYS = 50_000
#: Rows of one hash that are a share of it; hashes of a block at most, and at least where there are few; strips and columns
#: that are compared together; how many comparisons in blocks cost what one row of an index does.
SHARE, BLOCK_CODES, LEAST_BLOCK, STRIP, WIDE, IN_BLOCK = 1024, 32_768, 1024, 64, 2048, 100


def band_join(left: DataFrame, right: DataFrame, left_sec: str, right_sec: str, width: int) -> DataFrame:
    """Pairs at most `width` seconds apart: an equi-join on buckets of `width`, left in its own and right in three, then the exact test."""
    near = F.explode(F.array(*[F.floor(F.col(right_sec) / width) + i for i in (-1, 0, 1)]))
    pairs = left.withColumn("_bucket", F.floor(F.col(left_sec) / width)).join(right.withColumn("_bucket", near), "_bucket")
    return pairs.where(F.abs(F.col(left_sec) - F.col(right_sec)) <= width).drop("_bucket")


def nearest(pins: DataFrame, items: DataFrame, pin: str, pin_sec: str, item: str, item_sec: str, width: int | None = None, group: list[str] | None = None) -> DataFrame:
    """pin, item, distance: the item nearest in time (in the same group, if groups are given), the least item of equals.

    One pass over the union of both in order of time: each instant of a pin has the last item at or before it and
    the first one at or after it. Items of an instant are one row, pins of an instant too, before anything is
    sorted. Pins without a time, and without any item in their group, give no row. A fixed number of jobs. width is
    what callers of the band search gave; one pass needs none.
    """
    group = group or []
    times = items.where(F.col(item_sec).isNotNull()).groupBy(*group, F.col(item_sec).alias("_t")).agg(F.min(item).alias("_item"))
    asked = pins.where(F.col(pin_sec).isNotNull()).select(*group, F.col(pin_sec).alias("_t")).distinct()
    both = times.withColumn("_held", F.struct(F.col("_t").alias("at"), F.col("_item").alias("item"))).withColumn("_pin", F.lit(0)).drop("_item")
    both = both.unionByName(asked.withColumn("_held", F.lit(None).cast(both.schema["_held"].dataType)).withColumn("_pin", F.lit(1)))
    filled = carried(both, group, ["_t", "_pin"], "_held", "_next").where("_pin = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("_t")).alias("distance"), F.col(f"{c}.item").alias(item)))
    best = filled.select(*group, "_t", F.least(near("_held"), near("_next")).alias("_m")).where("_m is not null")
    return pins.withColumn("_t", F.col(pin_sec)).join(best, [*group, "_t"]).select(*group, pin, f"_m.{item}", "_m.distance")


def _nearest_of(vectors: np.ndarray, cids: np.ndarray, matrix: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the best centroid (the first of equals), its similarity, and whether it is near enough."""
    sims = np.round(vectors @ matrix.T, 12) if len(cids) else np.full((len(vectors), 1), -np.inf)
    best = sims.argmax(axis=1)
    top = sims[np.arange(len(best)), best]
    return cids[best] if len(cids) else np.zeros(len(best), np.int64), top, top >= threshold


def best_centroid(items: DataFrame, centroids: DataFrame, item: str, vector: str, threshold: float, most: int = BROADCAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """item, cid, sim: the most similar centroid (least cid of equals) at or above the threshold, null otherwise.

    Centroids of `most` bytes together (measured) go to every task and are compared as one matrix product
    a batch. More of them are dealt to blocks of that size, items to chunks, and every chunk meets every
    block in a task of its own, which keeps the best of each item; the best of the blocks is taken.
    """
    rows = centroids.select(F.col("cid").cast("long").alias("cid"), F.col("centroid").cast("array<double>").alias("centroid"))
    held = rows.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0)) * 8).first()[0]
    narrow = items.select(F.col(item).cast("long").alias(item), F.col(vector).cast("array<double>").alias("v"))
    result = f"{item} long, cid long, sim double"
    if held <= most:
        got = sorted((r["cid"], r["centroid"]) for r in rows.collect())  # `most` bytes
        cids, matrix = np.array([c for c, _ in got], np.int64), np.array([v for _, v in got], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cid, sim, ok = _nearest_of(np.array(batch.column(1).to_pylist(), float), cids, matrix, threshold)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid, mask=~ok), pa.array(sim, mask=~ok)], names=[item, "cid", "sim"])

        return narrow.mapInArrow(run, result)
    blocks, chunks = int(held // most) + 1, int(narrow.count() // chunk) + 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = narrow.withColumn("chunk", deal(item, chunks)).withColumn("block", every(blocks))
    right = rows.withColumn("block", deal("cid", blocks)).withColumn("chunk", every(chunks))

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs.sort_values("cid")
        matrix = np.array(theirs["centroid"].tolist(), float)
        cid, sim, ok = _nearest_of(np.array(mine["v"].tolist(), float).reshape(len(mine), -1), theirs["cid"].to_numpy(), matrix, threshold)
        return pd.DataFrame({item: mine[item].to_numpy(), "cid": pd.array(np.where(ok, cid, 0), "Int64").copy(), "sim": sim}).assign(cid=lambda d: d["cid"].where(ok), sim=np.where(ok, sim, np.nan))

    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(compare, result)
    return found.where("cid is not null").groupBy(item).agg(F.max(F.struct("sim", (-F.col("cid")).alias("c"))).alias("m")).join(narrow.select(item), item, "right").select(item, (-F.col("m.c")).alias("cid"), "m.sim")


def by_prefix(items: DataFrame, prefixes: DataFrame, text: str, override: Column, default: str) -> DataFrame:
    """items with `value`: that of a known override, else of the longest prefix of the lower-cased text, else the default.

    prefixes (prefix, value) is a small dimension table: each of its lengths is one equi-join key.
    """
    table = prefixes.select(F.lower("prefix").alias("prefix"), "value")
    lengths = sorted((r[0] for r in table.select(F.length("prefix")).distinct().collect()), reverse=True)
    out = items.join(table.withColumnRenamed("value", "_own").withColumnRenamed("prefix", "_o"), F.lower(override) == F.col("_o"), "left").drop("_o")
    names = []
    for n in lengths:
        names.append(f"_p{n}")
        side = table.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_k{n}"), F.col("value").alias(f"_p{n}"))
        out = out.join(side, F.substring(F.lower(F.col(text)), 1, n) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    return out.withColumn("value", F.coalesce("_own", *names, F.lit(default))).drop("_own", *names)


def preferred(left: DataFrame, right: DataFrame, key: str, order: list) -> DataFrame:
    """Left outer join with the one preferred row of the right side."""
    first = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return left.join(first, key, "left")


def hash_parts(distance: int, parts: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of parts such that two hashes of `bits` bits that differ in fewer than `distance` of them
    differ within the radius in one part at least: radii and one for each part add up to `distance`."""
    out, low = [], 0
    for k in range(parts):
        width = bits // parts + (k < bits % parts)
        out.append((low, width, distance // parts + (k < distance % parts) - 1))
        low += width
    return [p for p in out if p[2] >= 0]


def parts_for(distance: int, n: int, bits: int = 64) -> int:
    """How many parts make the least work for n hashes: keys that are asked for, and hashes that have one of them by chance."""

    return min(range(2, min(distance, bits // 4) + 1), key=lambda parts: _work(distance, parts, n, bits)) if distance > 1 else 1


def _work(distance: int, parts: int, n: int, bits: int) -> float:
    keys = [sum(comb(w, k) for k in range(r + 1)) for _, w, r in hash_parts(distance, parts, bits)]
    if max(keys) > MOST_KEYS:
        return float("inf")
    return n * sum(keys) + n * n * sum(k / 2**w for k, (_, w, _) in zip(keys, hash_parts(distance, parts, bits), strict=True))


def index_cost(distance: int, n: int, bits: int = 64) -> float:
    """Rows that an index with the best number of parts asks for and compares."""
    return _work(distance, parts_for(distance, n, bits), n, bits)


def _masked(code: Column, low: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, F.lit(low)).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(k: int, value: Column, flips: list[int]) -> Column:
    """struct(i, v) of part k for each way to flip bits of its value."""
    return F.transform(F.from_json(F.lit(str(flips)), "array<bigint>"), lambda x: F.struct(F.lit(k).alias("i"), value.bitwiseXOR(x).alias("v")))


def _beside(code: Column, low: int, width: int) -> Column:
    """The bits beside a part, as a number of their own."""
    below = code.bitwiseAND(F.lit((1 << low) - 1))
    return F.call_function("shiftrightunsigned", code, F.lit(low + width)).bitwiseOR(F.call_function("shiftleft", below, F.lit(64 - low - width))) if low + width < 64 else below


def _keys(rows: DataFrame, code: str, parts: list[tuple[int, int, int]], near: bool, names: tuple[str, str]) -> DataFrame:
    """rows with the number and the value of each part; near: also all values within the part's radius."""
    i, v = names
    each = []
    for k, (low, width, radius) in enumerate(parts):
        flips = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)] if near else [0]
        each.append(_flipped(k, _masked(F.col(code), low, width), flips))
    return rows.withColumn("_e", F.explode(F.concat(*each))).withColumn(i, F.col("_e.i")).withColumn(v, F.col("_e.v")).drop("_e")


def _first_part(a: str, b: str, parts: list[tuple[int, int, int]]) -> Column:
    """The first part in which two hashes are within the radius."""
    near = [hamming(_masked(F.col(a), low, width), _masked(F.col(b), low, width)) <= radius for low, width, radius in parts]
    return F.array_position(F.array(*near), F.lit(True)) - 1


def near_hashes(rows: DataFrame, key: str, code: str, distance: int, parts: int | None = None, hot: int = 10_000) -> DataFrame:
    """a, b, distance of the pairs of 64-bit hashes that differ in fewer than `distance` bits, a < b.

    Equal hashes are compared once. Different ones are compared by blocks, or indexed by parts (`by_parts`), whatever is less
    work for their number: a comparison in a block is some hundred times cheaper than one in a join, and a wide distance
    lets a large share of all pairs through any index. `parts` asks for the index. Blocks know the key of a hash that one row has, so
    such pairs leave their task as they are; keys of the rows that share a hash are joined to them, and no join can send
    the pairs to every task. Rows without a hash have no pair, nor has a row with others of its key. What comes out is as
    many rows as there are near pairs, which grows with the square of near-equal hashes; rows of a hash that many share are dealt to
    many tasks.
    """
    members = rows.where(F.col(code).isNotNull()).select(F.col(key).alias("k"), F.col(code).cast("long").alias("h"))
    count = F.count(F.lit(1))
    counted = checkpointed(members.groupBy("h").agg(F.ceil(count / SHARE).cast("int").alias("n"), count.alias("m"), F.when(count == 1, F.min("k")).alias("k")))
    n, n_large, n_many, n_several = counted.agg(count, F.count_if(F.col("n") > 1), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)), F.count_if(F.col("m") > 1)).first()
    large = counted.where("n > 1").select("h", "n")

    def shared(df: DataFrame, h: str, name: str) -> DataFrame:
        """df with the number of shares of its hash; what has more than one is a table of its own."""
        if not n_large:
            return df.withColumn(name, F.lit(1))
        more = large.select(F.col("h").alias(h), F.col("n").alias(name))
        return df.join(F.broadcast(more) if n_large <= BROADCAST_PARTS else more, h, "left").withColumn(name, F.coalesce(name, F.lit(1)))

    shares = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    share = lambda name: F.pmod(F.xxhash64("k"), F.col(name)).cast("int")

    def side(of: DataFrame, k: str, h: str, s: str) -> DataFrame:
        """Rows with their share of the rows of their hash."""
        return shared(of.select("k", F.col("h").alias(h)), h, "_n").select(F.col("k").alias(k), h, share("_n").alias(s), "_n")

    # rows that share their hash with others
    several = counted.where("m > 1").select("h")
    many = members.join(F.broadcast(several) if n_several <= BROADCAST_PARTS else several, "h", "left_semi")
    left, right = side(many, "x", "ha", "sa"), side(many, "y", "hb", "sb")
    both = left.withColumn("sb", shares("_n")).drop("_n").join(right.withColumn("sa", shares("_n")).withColumnRenamed("hb", "ha").drop("_n"), ["ha", "sa", "sb"])
    equal = both.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).cast("bigint").alias("distance"))
    if distance < 2:  # equal ones only, or none
        return equal.where(F.lit(distance == 1))
    if parts is None and n * n / 2 < IN_BLOCK * index_cost(distance, n):
        found, asked, few = by_blocks(counted.select("h", "k"), distance, n), many, n_many <= BROADCAST_PARTS and not n_large
    else:
        none = F.lit(None).cast(members.schema["k"].dataType)
        found, asked, few = by_parts(counted.select("h"), distance, parts or parts_for(distance, n), hot).select("ha", "hb", none.alias("x"), none.alias("y")), members, False
    if n_many or asked is members:
        dealt = shared(shared(found, "ha", "na"), "hb", "nb").withColumn("sa", shares("na")).withColumn("sb", shares("nb"))
        for k, h, s in (("x", "ha", "sa"), ("y", "hb", "sb")):
            own = side(asked, "_k", h, s).drop("_n")
            dealt = dealt.join(F.broadcast(own) if few else own, [h, s], "left").withColumn(k, F.coalesce(k, "_k")).drop("_k")
        found = dealt
    near = found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hamming(F.col("ha"), F.col("hb")).cast("bigint").alias("distance"))
    return near.unionByName(equal) if n_many else near


def by_blocks(codes: DataFrame, distance: int, n: int, block: int = BLOCK_CODES) -> DataFrame:
    """ha, hb, x, y: pairs of the n distinct hashes (h) that differ in fewer than `distance` bits, each once, with their keys (k):
    every block of hashes meets every other one, and itself, in a task, as arrays. Work grows with the square of the
    hashes, evenly dealt; a task has some blocks and the pairs of a strip of one of them."""
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // block), min(math.isqrt(8 * tasks), -(-n // LEAST_BLOCK)), 1)
    dealt = codes.withColumn("_b", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")).groupBy("_b").agg(F.collect_list(F.struct("h", "k")).alias("hs"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = dealt.withColumn("_o", other).select(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "hs")

    def compare(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in part:
            for r in range(batch.num_rows):
                mine = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                rows = batch.column(2)[r].values
                codes = (rows.field("h").to_numpy(), rows.field("k"))
                if mine[0] == mine[1]:
                    yield from _near_pairs(codes, codes, distance, True)
                elif mine == key:
                    yield from _near_pairs(first, codes, distance, False)
                    key, first = None, None
                else:
                    key, first = mine, codes

    kind = codes.schema["k"].dataType.simpleString()
    spread = met.repartition(max(min(tasks, blocks * blocks), blocks * blocks // 64), "i", "j").sortWithinPartitions("i", "j")
    return spread.mapInArrow(compare, f"ha long, hb long, x {kind}, y {kind}")


def _near_pairs(left: tuple[np.ndarray, pa.Array], right: tuple[np.ndarray, pa.Array], distance: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of hashes of two blocks and their keys, by strips of the first block; of a block with itself each pair once."""
    (a, x), (b, y) = left, right
    theirs = b.view(np.uint64)
    for begin in range(0, len(a), STRIP):
        mine = a[begin : begin + STRIP].view(np.uint64)[:, None]
        low = begin if same else 0
        got = []
        for at in range(low, len(b), WIDE):
            part = theirs[None, at : at + WIDE]
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(mine ^ part) < distance), part.shape[1])
            i, j = i + begin, j + at
            got.append((i[j > i], j[j > i]) if same else (i, j))
        i, j = (np.concatenate(side) for side in zip(*got, strict=True))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), x.take(pa.array(i)), y.take(pa.array(j))], names=["ha", "hb", "x", "y"])


def by_parts(codes: DataFrame, distance: int, parts: int, hot: int) -> DataFrame:
    """ha, hb of the distinct hashes (h) that differ in fewer than `distance` bits, ha < hb, by an index on parts.

    Of two near hashes one part differs within its radius (`hash_parts`), so one side asks for all values that near. How
    many parts is what makes the least work for the number of hashes: with 12 bits 3 parts for many hashes, 4918 values
    each, which one in 500 others has by chance. A value of a part that more than `hot` hashes share (they are
    counted) is asked for by a second index on the other bits, exact in the same way.
    """
    first = hash_parts(distance, parts)
    index = _keys(codes.withColumnRenamed("h", "hb"), "hb", first, False, ("i", "v"))
    large = index.groupBy("i", "v").count().where(F.col("count") > hot).select("i", "v", F.lit(True).alias("_hot"))
    large = checkpointed(large)
    n = large.count()
    asked = _keys(codes.withColumnRenamed("h", "ha"), "ha", first, True, ("i", "v"))
    if n:
        few = F.broadcast(large) if n <= BROADCAST_PARTS else large
        index, asked = index.join(few, ["i", "v"], "left"), asked.join(few, ["i", "v"], "left")
    cold = (lambda df: df.where("_hot is null").drop("_hot")) if n else (lambda df: df)
    apart = (F.col("ha") < F.col("hb")) & (hamming(F.col("ha"), F.col("hb")) < distance)
    found = cold(asked).join(cold(index), ["i", "v"]).where(apart & (_first_part("ha", "hb", first) == F.col("i"))).select("ha", "hb")
    for k, (low, width, _) in enumerate(first if n else []):
        second = hash_parts(distance, 3, 64 - width)
        mine, theirs = (df.where(F.col("_hot") & (F.col("i") == k)).drop("_hot").withColumn(name, _beside(F.col(c), low, width)) for df, name, c in ((asked, "ra", "ha"), (index, "rb", "hb")))
        pairs = _keys(mine, "ra", second, True, ("j", "u")).join(_keys(theirs, "rb", second, False, ("j", "u")), ["i", "v", "j", "u"])
        found = found.unionByName(pairs.where(apart & (_first_part("ha", "hb", first) == k) & (_first_part("ra", "rb", second) == F.col("j"))).select("ha", "hb"))
    return found
