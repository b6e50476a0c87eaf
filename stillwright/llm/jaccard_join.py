"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Documents with the same set of shingles are one node. Each of TREES tries holds the nodes under a path
of DEPTH minhashes, a byte each, and is sorted by path: what a node shares with its neighbours there is
its longest common prefix. Nodes that share a prefix of DEPTH levels meet first; whole signatures
screen the pairs of a meeting place, so strangers who share boilerplate go no further, and the
similarities of the pairs that are left tell how many a prefix of each length misses. The matched
prefix is then shortened to the longest one that keeps the target recall. Screened pairs are a
spanning forest of each place, never listed; inside the groups they form all pairs are verified on
whole shingle sets, large groups block against block, and a task returns counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import column, discard, materialize, shuffle_partitions, steps, text_hash, texts
from stillwright.llm.components import ROWS, components, labels
from stillwright.llm.wordhash import Words, byte_class, constants, mix

TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Bits of a level of a path; a path is 64 bits.
LEVEL = 8
#: Standard deviations that the agreement of two signatures may fall short of the threshold's.
SPARED = 5.0
#: Nodes of a meeting place, and documents of a group, that a block holds; two blocks are compared at a time.
PLACE, BLOCK = 1024, 256
#: Members whose ids go to every task at most; beyond it texts are joined to them by shuffling.
BROADCAST_MEMBERS = 1_000_000
#: Cells of the 0/1 matrix that blocks are compared by.
CELLS = 8_000_000
#: Words are runs of ASCII letters and digits and of all other characters than ASCII ones, lowered.
INSIDE = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Four signs for each byte: their products with those of another byte are 4 if the bytes are equal, else 0 on average.
SIGNS = np.where(mix(np.arange(1024, dtype=np.uint64) + np.uint64(77)) >> np.uint64(63), 1, -1).astype(np.float32).reshape(256, 4)


def recall_at(similarity: float, trees: int, prefix: int) -> float:
    """Chance that two sets share a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def least_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from depth down, at which even a pair at the threshold has the recall: none needs to be shorter."""
    return next((r for r in range(depth, 1, -1) if recall_at(threshold, trees, r) >= recall), 1)


def prefix_length(found: dict[int, float], size: int, threshold: float, trees: int, depth: int, floor: int, recall: float) -> int:
    """The longest prefix that keeps the recall of what exists, from how often pairs met at `depth`.

    found: meetings by agreeing levels of `size`. A pair of similarity s meets trees * s ** depth times on
    average, so meetings over that estimate the pairs of each similarity, found or not. Without any the
    floor is taken.
    """
    pairs = {(s := min(max(n / size, threshold), 1.0)): 0.0 for n in found}
    for n, times in found.items():
        s = min(max(n / size, threshold), 1.0)
        pairs[s] += times / (trees * s**depth)
    total = sum(pairs.values())
    return next((r for r in range(depth, floor, -1) if total and sum(k * (1 - recall_at(s, trees, r)) for s, k in pairs.items()) <= (1 - recall) * total), floor)


class Shingles:
    """Distinct shingle hashes of a block of texts: values[bounds[i]:bounds[i + 1]], sorted, of text i.

    A text of fewer words than a shingle has one shingle of all its words, one without words none.
    """

    def __init__(self, block: list[str], size: int) -> None:
        words = Words([t.lower().encode() for t in block], INSIDE)
        at, h = words.windows(size)
        owner = words.owner()[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        for i in short.tolist():
            mine = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            h = np.append(h, mix((mine * constants(len(mine), 99 + len(mine))).sum(dtype=np.uint64, keepdims=True)))
            owner = np.append(owner, i)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.empty(0, bool)
        self.values, self.owner = h[new], owner[new]
        self.counts = np.bincount(self.owner, minlength=len(block))
        self.bounds = np.cumsum([0, *self.counts])

    def sums(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each set."""
        out = np.zeros(len(self.counts), np.uint64)
        full = np.flatnonzero(self.counts)
        if len(full):
            out[full] = np.add.reduceat(mix(self.values * constants(1, seed)[0]), self.bounds[full])
        return mix(out + self.counts.astype(np.uint64))

    def named(self, bits: int) -> np.ndarray:
        """The hash that names each set, of so many bits."""
        return (self.sums(1) >> np.uint64(64 - bits)).view(np.int64)

    def paths(self, trees: int, depth: int) -> np.ndarray:
        """For each set its path in each tree: a byte of each of `depth` minhashes, the first in the highest place."""
        full = np.flatnonzero(self.counts)
        out = np.zeros((len(self.counts), trees), np.uint64)
        for t in range(trees if len(full) else 0):
            for c in constants(depth, 1000 + t):
                least = np.minimum.reduceat(self.values * c, self.bounds[full])
                out[full, t] = out[full, t] << np.uint64(LEVEL) | mix(least) >> np.uint64(64 - LEVEL)
        return out


def _nodes(size: int, trees: int, depth: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            s = Shingles(column(part, "text").to_pylist(), size)
            paths = s.paths(trees, depth).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(s.counts) + 1, dtype=np.int32) * trees), pa.array(paths.reshape(-1)))
            columns = {"doc_id": column(part, "doc_id"), "text_hash": column(part, "text_hash"), "node": pa.array(s.named(bits)), "check": pa.array(s.sums(2).view(np.int64)), "n_shingles": pa.array(s.counts.astype(np.int64)), "paths": flat}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _shingled(size: int, bits: int):
    """Nodes of texts with their sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, most=250_000):
            s = Shingles(column(part, "text").to_pylist(), size)
            sets = [s.values[a:b].tobytes() for a, b in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.named(bits)), pa.array(s.sums(2).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "check", "shingles"])

    return run


def _apart_by_check(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Rows (node, check) with other nodes where different sets share one; how many of these there are grows with
    the square of the sets over 2**64, some tens for 10**10 sets."""
    if shared is None:
        return rows
    rows = rows.join(F.broadcast(shared.withColumn("_shared", F.lit(True))), "node", "left")
    return rows.withColumn("node", F.when(F.col("_shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_shared")


def _matched(depth: int, floor: int):
    """Rows (tree, path, node) of a sorted range that share `floor` levels or more with a neighbour, and how
    many they share (deep). The first and last rows of a range have neighbours elsewhere and stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        before = depth  # levels that the held row shares with the one before it
        for batch in _ended(batches):
            rows = held if batch is None else np.concatenate([held, np.stack([column(batch, c).to_numpy() for c in ("tree", "path", "node")], axis=1).astype(np.int64)])
            if not len(rows):
                continue
            apart = (rows[1:, 1] ^ rows[:-1, 1]).view(np.uint64)
            shared = sum((apart >> np.uint64(LEVEL * (depth - d)) == 0).astype(np.int64) for d in range(1, depth + 1)) * (rows[1:, 0] == rows[:-1, 0])
            deep = np.maximum(np.append(before, shared), np.append(shared, depth))
            mine = slice(0, len(rows) if batch is None else len(rows) - 1)
            held, before = rows[-1:], int(shared[-1]) if len(shared) else before
            keep = np.flatnonzero(deep[mine] >= floor)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(rows[keep, 0].astype(np.int32)), pa.array(rows[keep, 1]), pa.array(rows[keep, 2]), pa.array(deep[keep].astype(np.int32))], names=["tree", "path", "node", "deep"])

    return run


def _ended(batches: Iterator) -> Iterator:
    """The batches and a None after them."""
    yield from batches
    yield None


def _agreement(signatures: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """How many bytes signatures have in common with all others, some rows at a time: counted for a few,
    from products of signs for many."""
    n = len(signatures)
    if n <= 64:
        yield slice(0, n), (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2).astype(np.float32)
        return
    signs = SIGNS[signatures].reshape(n, -1)
    for k in range(0, n, ROWS):
        yield slice(k, k + ROWS), signs[k : k + ROWS] @ signs.T / 4


def _runs(keys: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each key, the least node first."""
    order = np.lexsort((node, keys))
    yield from np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else ()


def _apart(side: np.ndarray) -> np.ndarray:
    """Pairs that a cell compares. Sides 1 and 2 are different blocks: pairs inside either are another
    cell's; side 0 is a whole group or block."""
    out = (side[:, None] == 0) | (side[:, None] != side[None, :])
    np.fill_diagonal(out, False)
    return out


def _screen(threshold: float):
    """Of each meeting place a spanning forest (a, b) of the pairs whose signatures agree enough, and how
    many pairs there are by agreeing levels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple] = []
        side, node, times = (pdf[c].to_numpy() for c in ("side", "node", "times"))
        signatures = np.stack(pdf["paths"].to_list()).astype(np.int64).view(np.uint8)
        size = signatures.shape[1]
        spread = np.sqrt(size * threshold * (1 - threshold) + size * (1 - threshold) / 4)
        met = np.zeros(size + 1)
        for at in _runs(pdf["grp"].to_numpy(), node):
            linked = _apart(side[at])
            for rows, agree in _agreement(signatures[at]):
                near = np.rint(agree[linked[rows] & (agree >= size * threshold - spread)]).astype(np.int32).clip(0, size)
                met += np.bincount(near, minlength=size + 1) * (times[at[0]] / 2)
                linked[rows] &= agree >= size * threshold - SPARED * spread
            root = labels(linked)
            moved = np.flatnonzero(root != np.arange(len(at)))
            edges += zip(node[at[moved]].tolist(), node[at[root[moved]]].tolist(), strict=True)
        seen = np.flatnonzero(met)
        return pd.DataFrame({"a": [a for a, _ in edges] + [0] * len(seen), "b": [b for _, b in edges] + [0] * len(seen), "level": [-1] * len(edges) + seen.tolist(), "n": [0.0] * len(edges) + met[seen].tolist()})

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, by products of 0/1 matrices over the shared values."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]], float)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[code]
    owner, code = owner[keep], number[code[keep]]
    out, width = np.zeros((n, n)), max(CELLS // n, 1)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for begin in range(0, int(often.sum()), width):
        a, b = np.searchsorted(code, [begin, begin + width])
        m = np.zeros((n, min(width, int(often.sum()) - begin)), np.float32)
        m[owner[a:b], code[a:b] - begin] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    def of_group(side: np.ndarray, node: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(x) for x in sets], float)
        both = _shared(sets)
        linked = (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9) & _apart(side)
        links, root = linked @ copies, labels(linked)
        for i in np.flatnonzero(links):
            yield int(node[i]), int(links[i]), int(node[root[i]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side, node, copies = (pdf[c].to_numpy() for c in ("side", "node", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        out = [x for at in _runs(pdf["grp"].to_numpy(), node) for x in of_group(side[at], node[at], copies[at], [sets[i] for i in at])]
        return pd.DataFrame(out, columns=["node", "links", "root"])

    return run


def _dealt(members: DataFrame, key: str, size: Column, block: int, cells: int) -> DataFrame:
    """Members of groups `key` of `size` dealt to cells: small groups whole, several to a cell; large ones by
    pairs of blocks, to which a hash of the node deals, so that a block has about `block` members."""
    blocks = F.when(size > 2 * block, F.ceil(size / block)).otherwise(1).cast("int")
    rows = members.withColumn("_blocks", blocks).withColumn("_mine", F.pmod(F.xxhash64("node", F.lit(5)), "_blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, F.col("_mine")).alias("i"), F.greatest(k, F.col("_mine")).alias("j")))
    rows = rows.withColumn("_p", F.explode(pairs)).withColumn("grp", F.xxhash64(key, "_p.i", "_p.j"))
    rows = rows.withColumn("cell", F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64(key), F.lit(4 * cells))).otherwise(F.col("grp")))
    side = F.when((F.col("_p.i") == F.col("_p.j")), 0).when(F.col("_p.i") == F.col("_mine"), 1).otherwise(2)
    return rows.withColumn("side", side).drop("_blocks", "_mine", "_p", key)


def _met(forest: DataFrame, sets: DataFrame, prefix: int, depth: int, threshold: float, place: int) -> tuple[DataFrame, dict[int, float]]:
    """Edges of the nodes that share `prefix` levels of a path and pass the screen, and the meetings by
    agreeing levels. Places with the same nodes in several trees are screened once."""
    rows = forest.where(F.col("deep") >= prefix).select("tree", F.call_function("shiftrightunsigned", "path", F.lit(LEVEL * (depth - prefix))).alias("prefix"), "node")
    same = ["n", "f", "g"]
    places = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")).where("n > 1")
    places = places.groupBy(*same).agg(F.min(F.struct("tree", "prefix")).alias("p"), F.count(F.lit(1)).alias("times")).select("p.tree", "p.prefix", "n", "times")
    members = rows.join(places, ["tree", "prefix"]).select(F.xxhash64("tree", "prefix").alias("place"), "node", "n", "times")
    placed = _dealt(members, "place", F.col("n"), place, shuffle_partitions(forest.sparkSession)).drop("n").join(sets.select("node", "paths"), "node")
    found = materialize(placed.groupBy("cell").applyInPandas(_screen(threshold), "a long, b long, level int, n double"), "met", free=False)
    met = {r["level"]: r["n"] for r in found.where("level >= 0").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    return found.where("level < 0").select("a", "b"), met


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, place: int = PLACE, broadcast_members: int = BROADCAST_MEMBERS, node_bits: int = 64) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_copies, first of every row.

    Two rows are linked if the Jaccard similarity of their sets of `shingle` words is at least `threshold`.
    class_id: the least doc_id that a chain of links reaches. n_links: linked rows, equal ones among them
    (n_copies of those). first: whether the row has the id and the text that stand for its class, the least
    id (none comes last) and then the least text_hash (128 bits that name the text).

    Texts of fewer words are one shingle; texts without words, null ones too, are equal to each other.
    Rows are judged by their texts alone: repeated rows are copies of each other, rows of one id with
    different texts may be in different classes, and rows without an id have links like all others; a
    class of such rows only has no class_id. node_bits: bits of the hash that names a set; a second hash tells apart sets that share it. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    floor = least_prefix(threshold, trees, depth, 1 - (1 - recall) / 10)
    rows = texts(docs).withColumn("text_hash", text_hash(F.col("text")))
    nodes = materialize(rows.mapInArrow(_nodes(shingle, trees, depth, node_bits), "doc_id long, text_hash binary, node long, check long, n_shingles long, paths array<long>"), "signatures", free=False)
    # one node for each distinct set: sets that share a node by chance get names of both hashes
    shared = materialize(nodes.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").select("node"), "shared", free=False)
    shared = shared if shared.count() else None
    nodes = _apart_by_check(nodes, shared)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    sets = nodes.groupBy("node", "check").agg(least.alias("least"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"), F.max("n_shingles").alias("n_shingles")).drop("check")
    sets = materialize(sets, "sets")
    paths = sets.where("n_shingles > 0").select(F.posexplode("paths").alias("tree", "path"), "node")
    order = ["tree", "path", "node"]
    forest = paths.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_matched(depth, floor), "tree int, path long, node long, deep int")
    forest = materialize(forest, "forest")
    edges, met = _met(forest, sets, depth, depth, threshold, place)
    prefix = prefix_length(met, trees * depth, threshold, trees, depth, floor, recall)
    if prefix < depth:
        discard(edges)
        edges, _ = _met(forest, sets, prefix, depth, threshold, place)
    groups = components(edges)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = materialize(groups.join(sizes, "root").join(sets.select("node", "copies", "least"), "node"), "members", free=False)
    discard(forest)
    # texts of the members: only rows of the ids that name them are read for their words
    ids = members.select("least.doc_id").where("doc_id is not null").distinct()
    n_members, nameless = members.agg(F.count(F.lit(1)), F.count_if(F.col("least.none"))).first()
    read = rows.join(F.broadcast(ids) if n_members <= broadcast_members else ids, "doc_id", "left_semi")
    if nameless:
        read = read.unionByName(rows.where("doc_id is null"))
    placed = _dealt(members.select("node", "root", "n", "copies"), "root", F.col("n"), block, shuffle_partitions(spark)).drop("n")
    shingled = read.select("text").mapInArrow(_shingled(shingle, node_bits), "node long, check long, shingles binary")
    shingled = _apart_by_check(shingled, shared).groupBy("node").agg(F.first("shingles").alias("shingles"))
    found = placed.join(shingled, "node").groupBy("cell").applyInPandas(_verify(threshold), "node long, links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    heads = linked.join(sets.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("head"))
    named = sets.select("node", "least", "copies").join(links, "node", "left").join(linked.join(heads, "root").select("node", "head"), "node", "left")
    named = named.select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", "least").alias("head"))
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return nodes.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"), first.alias("first"))
