"""Phrase collocations by Apriori passes, level by level.

A pass counts the k-word runs of all texts, but only those whose two overlapping runs of k - 1 words
are both frequent: a phrase is never more frequent than what it contains. The frequent runs of the level before
go to every task as a bitmap of their hashes, whose size is bounded; what it lets through by chance
is counted as well and fails by its own count, so that the tables of frequent runs are exact. Cuts and
longer phrases are then looked up in these tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwright.llm.common import column, materialize, steps
from stillwright.llm.wordhash import constants, mix

#: Bytes of text that a step counts together, bits of a bitmap (a frequent run takes 16, up to 32 MB in all),
#: bits of one of its rows, bytes of a table of frequent runs that goes to every task.
STEP_BYTES, LEAST_BITS, MOST_BITS, ROW_BITS, BROADCAST_BYTES = 2_000_000, 20, 28, 20, 16_000_000
#: Shares of a language whose candidates are ranked for themselves first.
SHARES = 32
#: What ends a piece, what ends a word.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
COUNTS = "lang string, phrase string, n long"

_end = re.compile(b"[" + re.escape(ENDS) + b"]").search
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_kind = np.zeros(256, np.uint8)
_kind[list(GAPS)] = 1
_kind[list(ENDS)] = 2


class Tokens:
    """Words of a block of texts of one language, as numbers of a vocabulary of the block."""

    def __init__(self, block: list[bytes], lang: str) -> None:
        raw = _lower[np.frombuffer(b"\n".join(block) + b"\n", np.uint8)]
        kind = _kind[raw]
        word = kind == 0
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, lens = edges[::2], edges[1::2] - edges[::2]
        offsets = np.append(0, np.cumsum(lens)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
        coded = words.dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.lang = lang

    def hashes(self) -> np.ndarray:
        return word_hashes(self.vocabulary.to_pylist(), self.lang)

    def runs(self, k: int, frequent: Bitmap | None) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct runs of k words of one piece, as k columns of numbers, and how often each occurs."""
        if k == 1:
            return [np.arange(len(self.vocabulary))], np.bincount(self.ids, minlength=len(self.vocabulary))
        words = self.hashes()[self.ids]
        known = frequent.has(gram_hashes([words[j : len(words) - (k - 2) + j] for j in range(k - 1)]))
        n = max(len(self.ids) - k + 1, 0)
        at = np.flatnonzero(known[:n] & known[1 : n + 1] & (self.piece[:n] == self.piece[k - 1 : k - 1 + n]))
        size = max(len(self.vocabulary), 1)
        if size**k < 2**63:
            code = np.zeros(len(at), np.int64)
            for j in range(k):
                code = code * size + self.ids[at + j]
            code, times = np.unique(code, return_counts=True)
            return [code // size ** (k - 1 - j) % size for j in range(k)], times
        # a run is numbered by the number of its first words and its last word
        code, first = self.ids[at], np.arange(len(at))
        for j in range(1, k):
            _, first, code, times = np.unique(code * size + self.ids[at + j], return_index=True, return_inverse=True, return_counts=True)
        return [self.ids[at[first] + j] for j in range(k)], times

    def phrases(self, columns: list[np.ndarray]) -> pa.Array:
        parts = [self.vocabulary.take(pa.array(c)) for c in columns]
        joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.binary()).view(pa.string())


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut where a piece ends; a longer piece stays whole."""
    begin = 0
    while len(text) - begin > size:
        m = _end(text, begin + size)
        if not m:
            break
        yield text[begin : m.end()]
        begin = m.end()
    yield text[begin:] if begin else text


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for h, c in zip(columns, constants(len(columns)), strict=True):
        total += h * c
    return mix(total)


class Bitmap:
    """Which hashes belong to frequent runs; a few others pass, too."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.bytes = bits, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(frequent: DataFrame) -> Bitmap:
    """Of a table of frequent runs (lang, phrase). Its bytes, at most 32 MB, go through the driver; the runs don't."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(16 * max(frequent.count(), 1))))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at = column(batch, "lang").to_pylist(), []
            for lang, phrase in zip(langs, column(batch, "phrase").to_pylist(), strict=True):
                at.append(word_hashes(phrase.encode().split(b" "), lang))
            lens = np.array([len(x) for x in at], np.int64)
            flat, begins, found = np.concatenate(at) if at else np.empty(0, np.uint64), np.cumsum(lens) - lens, np.empty(len(at), np.uint64)
            for k in np.unique(lens).tolist():
                rows = np.flatnonzero(lens == k)
                found[rows] = gram_hashes([flat[begins[rows] + j] for j in range(k)])
            yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(64 - bits)).astype(np.int64))], names=["place"])

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        one = np.zeros(1 << ROW_BITS, bool)
        one[pdf["low"].to_numpy()] = True
        return pd.DataFrame({"row": pdf["row"][:1], "bits": [np.packbits(one, bitorder="little").tobytes()]})

    known = frequent.mapInArrow(places, "place long").distinct().selectExpr(f"cast(place >> {ROW_BITS} as int) row", f"cast(place & {(1 << ROW_BITS) - 1} as int) low")
    out = np.zeros((max(1, 1 << (bits - ROW_BITS)), (1 << ROW_BITS) // 8), np.uint8)
    for r in known.groupBy("row").applyInPandas(row, "row int, bits binary").collect():
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(bits, out.reshape(-1))


def counted(rows: DataFrame, k: int, least: int, frequent: Bitmap | None) -> DataFrame:
    """lang, phrase, n: runs of k words that occur `least` times or more; for k = 1 also the number of all words of each language, under the empty phrase."""
    known = rows.sparkSession.sparkContext.broadcast(frequent) if frequent else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, most=STEP_BYTES):
            langs = column(part, "lang").dictionary_encode()
            owner = langs.indices.to_numpy()
            block = column(part, "text").cast(pa.binary())
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = block.filter(pa.array(owner == i)).to_pylist()
                # a text beyond a step is a step of its own, and is counted by parts
                for many in ([x] for x in parts(own[0], STEP_BYTES)) if len(own) == 1 else [own]:
                    tokens = Tokens(many, lang)
                    if len(tokens.ids) < k:
                        continue
                    columns, times = tokens.runs(k, known.value if known else None)
                    found, n = tokens.phrases(columns), pa.array(times, pa.int64())
                    if k == 1:
                        found, n = pa.concat_arrays([found, pa.array([""])]), pa.concat_arrays([n, pa.array([len(tokens.ids)], pa.int64())])
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), found, n], names=["lang", "phrase", "n"])

    return rows.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _looked_up(rows: DataFrame, levels: DataFrame, key: str, out: str, few: bool) -> DataFrame:
    table = levels.select("lang", F.col("phrase").alias(key), F.col("n").alias(out))
    return rows.join(F.broadcast(table) if few else table, ["lang", key])


def _part(begin: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", begin, length))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, first: int = 2000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first phrases by score.

    A-Z are lower-cased; texts fall into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs.
    Candidates are runs of 2 to `longest` words of one piece that occur a >= least times, overlaps included. A cut into two parts
    that occur l and r times scores floor(1000000 * a * a / (l * r)); the lowest cut counts, of equal ones the
    first. Candidates go that lie in a longer one with 100 * f(longer) >= inside * a. Order: score and a falling, phrase rising by bytes.

    A null text is empty and gives nothing, a null lang is `und` (one language with rows that say so); every row counts, repeated
    ones each time; the id is not read. Numbers are exact: products have 38 digits, enough for a below 10**15. A text
    longer than a step is counted by parts that end where pieces do. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).where("text is not null and text != ''")
    levels, frequent = None, None
    for k in range(1, longest + 1):
        level = materialize(counted(rows, k, least, frequent), f"level{k}")
        if k == 1:
            sizes, level = level.where("phrase = ''").select("lang", F.col("n").alias("total")), level.where("phrase != ''").where(F.col("n") >= least)
        levels = level if levels is None else levels.unionByName(level)
        frequent = bitmap(level) if k < longest else None
    few = (levels.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 40)).first()[0] or 0) <= broadcast_bytes
    candidates = levels.withColumn("words", F.split("phrase", " ", -1)).withColumn("k", F.size("words")).where("k > 1").withColumnRenamed("n", "a")

    cut = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cut = cut.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cut = _looked_up(_looked_up(cut, levels, "left", "l", few), levels, "right", "r", few)
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cut = cut.withColumn("above", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", exact("l") * exact("r"))
    cut = cut.withColumn("score", F.expr("above div below"))
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")

    parts = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> concat_ws(' ', slice(words, i, m)))))")
    longer = candidates.where("k > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(F.broadcast(longer) if few else longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a")
    # a language's first ones are among the first of each of its shares: no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shared = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    shared = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first).drop("share", "rank")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(F.broadcast(sizes) if few else sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
