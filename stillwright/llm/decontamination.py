"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words: the hash of the words at its marked places ignores
the others, so a substitution there does not hide a match. The masks are chosen so that every
alignment that satisfies the rule shares a seed. Seeds of documents meet seeds of benchmark items;
each alignment that any seed suggests is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import bound, materialize, text_hash, texts

#: Masks for items from 10 words on; a mark compares the word at its place. Wherever 3 words of 13, or 2
#: of 10 to 12, differ, one of them has a place without any (a test tries all).
MASKS = ("111011", "1100001011", "11010011")
LEAST_MASKED = max(map(len, MASKS))
#: Words of the window that is verified, and those of it that must be equal.
WINDOW, EQUAL = 13, 10
#: Benchmark seeds, bytes of benchmark texts, and hashes of texts that are broadcast at most; beyond it joins shuffle.
BROADCAST_SEEDS, BROADCAST_BYTES, BROADCAST_TEXTS = 1_000_000, 32_000_000, 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lowered."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def masks_of(n: int, window: int = WINDOW, equal: int = EQUAL) -> tuple[str, ...]:
    """Masks that every alignment of an item of n words meets if it satisfies the rule: those above, or
    the run of equal words that is left between so many differing ones."""
    width = min(n, window)
    if width >= LEAST_MASKED and (window, equal) == (WINDOW, EQUAL):
        return MASKS
    least = -(-width * equal // window)
    return ("1" * max(1, -(-least // (width - least + 1))),)


def seeds(hashes: Column, masks: dict[str, Column | None]) -> Column:
    """Of an array of word hashes the seed hashes of all masks at the first place, at the second, and so
    on; null where a mask does not fit or its condition does not hold."""
    places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        return F.array(*[F.when((i + len(mask) <= F.size(hashes)) & (F.lit(True) if only is None else only), F.xxhash64(F.lit(mask), *[F.get(hashes, i + k) for k, c in enumerate(mask) if c == "1"])) for mask, only in masks.items()])

    return F.flatten(F.transform(places, at))


def _seeded(rows: DataFrame, key: list[str], masks: dict[str, Column | None]) -> DataFrame:
    """key, seed, place of every seed; what is exploded is the key and the hashes alone."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    found = rows.select(*key, F.posexplode(bound(hashes, lambda h: seeds(h, masks))).alias("k", "seed")).where("seed is not null")
    return found.select(*key, "seed", F.floor(F.col("k") / len(masks)).cast("int").alias("place"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, equal: int = EQUAL, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """text_hash, item, item_words, matched, window_matched of each distinct text that holds an item's words.

    See `contaminations`. Items are named by their texts (item is their text_hash), so every row of the benchmark
    counts. Equal texts are verified once, whatever rows they stand in. Only texts that a seed has hit are read
    again, and each is split into words once, before it meets its alignments. Of items whose words must all be
    equal a text's first hit says all there is to know, so a common word as an item is one alignment a text.
    """
    items = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("item", text_hash(F.col("text")))
    items = items.dropDuplicates(["item"]).select("item", words(F.col("text")).alias("words"))
    length = F.length(F.array_join("words", " "))
    found = items.where(F.size("words") > 0).groupBy(F.least(F.size("words"), F.lit(window)).alias("width")).agg(F.sum(F.size("words")).alias("n"), F.sum(length).alias("bytes")).collect()
    widths = {r["width"]: r["n"] for r in found}
    by_mask: dict[str, list[int]] = {mask: [] for mask in MASKS[:1]} if not widths else {}
    for width in sorted(widths):
        for mask in masks_of(width, window, equal):
            by_mask.setdefault(mask, []).append(width)
    width = F.least(F.size("words"), F.lit(window))
    # a mask as long as the item: what it hits is the item
    item_seeds = _seeded(items.withColumn("all", F.size("words").isin([n for n in widths if masks_of(n, window, equal) == ("1" * n,)])), ["item", "all"], {mask: width.isin(held) for mask, held in by_mask.items()}).withColumnRenamed("place", "item_place")
    rows = texts(docs).select("text").withColumn("text_hash", text_hash(F.col("text")))
    few = sum(n * len(masks_of(width, window, equal)) for width, n in widths.items()) <= broadcast_seeds
    small = few and 4 * sum(r["bytes"] for r in found) <= BROADCAST_BYTES
    seeded = _seeded(rows.select("text_hash", words(F.col("text")).alias("words")), ["text_hash"], dict.fromkeys(by_mask))
    hits = seeded.join(F.broadcast(item_seeds) if few else item_seeds, "seed").withColumn("shift", F.col("place") - F.col("item_place"))
    hits = hits.groupBy("text_hash", "item", F.when(~F.col("all"), F.col("shift")).alias("_at")).agg(F.min("shift").alias("shift")).drop("_at")
    hits = materialize(hits, "alignments", free=False)
    hit = hits.select("text_hash").distinct()
    read = rows.join(F.broadcast(hit) if hit.count() <= BROADCAST_TEXTS else hit, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    read = read.select("text_hash", words(F.col("text")).alias("mine"))
    item_words = items.withColumnRenamed("words", "item_words")
    hits = hits.join(F.broadcast(item_words) if small else item_words, "item")

    def verified(item: Column, mine: Column, shift: Column) -> Column:
        width = F.least(F.lit(window), F.size(item))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
        best = lambda same: F.array_max(F.transform(F.sequence(F.lit(1), F.size(item) - width + 1), lambda i: total(F.slice(same, i, width))))
        same = F.transform(item, lambda w, k: F.when(F.get(mine, shift + k) == w, 1).otherwise(0))
        return bound(same, lambda x: F.struct(F.size(item).alias("item_words"), total(x).alias("matched"), best(x).alias("window_matched")))

    checked = hits.join(read, "text_hash").select("text_hash", "item", verified(F.col("item_words"), F.col("mine"), F.col("shift")).alias("v")).select("text_hash", "item", "v.*")
    enough = F.col("window_matched") * window >= F.least(F.lit(window), F.col("item_words")) * equal
    return checked.where(enough).groupBy("text_hash", "item").agg(*[F.max(c).alias(c) for c in ("item_words", "matched", "window_matched")])


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, equal: int = EQUAL, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, item_words, matched, window_matched of each document that holds an item's words.

    A pair counts if, in any alignment, a window of `window` aligned words of the item (all of a shorter
    item) has at least `equal` equal ones (the same share of a shorter item, so of up to 4 words of 13
    with 10 equal ones all). matched: equal words of the best such alignment. Items of a few common
    words are found wherever these stand; null and empty texts match nothing. Rows with a null doc_id
    are left out. Every benchmark row counts, with a null item_id too; of rows that share an item_id, and of rows of
    one doc_id, the best match is returned. Empty tables give an empty result. Other columns are not read.

    Seeds leave the documents' rows without their words, and each alignment is counted before it is
    shuffled, so a passage that many documents share is no hot key: rows are keyed by their text.
    """
    found = materialize(contaminated_texts(docs, benchmark, window, equal, broadcast_seeds), "contaminated", free=False)
    n = found.count()
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_hash(F.col("text")).alias("item")).distinct()
    found = materialize(named.join(F.broadcast(found) if n <= BROADCAST_TEXTS else found, "item").drop("item"), "named", free=False)
    n = found.count()
    rows = texts(docs).where("doc_id is not null").select("doc_id", text_hash(F.col("text")).alias("text_hash"))
    return rows.join(F.broadcast(found) if n <= BROADCAST_TEXTS else found, "text_hash").groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("item_words", "matched", "window_matched")])
