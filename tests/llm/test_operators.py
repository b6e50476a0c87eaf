"""Each operator against plain Python on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stillwright.llm import components as cc
from stillwright.llm import decontamination, fingerprints, jaccard_join, main_text, packing, pii, quality, sharding, substring_dedup, token_counts

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "\n\n", "a", "  a  b ", "the\x00 \x1cword\x85x\xa0y", "<|endoftext|> and <|endof", "İSTANBUL Ünï ß 'S 日本語", "x" * 5000, "été's 123 !!"]
CLASHING = {"length": "n", "n_words": "n", "bucket": "n", "node": "n", "rank": "n", "task": "n", "hits": "n", "seed": "n", "shard": "n", "item": "n", "words": "n", "k": "n", "task_id": "n"}


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" + rnd.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = [prose(rnd, rnd.choice([3, 12, 13, 40, 90, 200])) for _ in range(60)]
    base, passage = prose(rnd, 120), prose(rnd, 30)
    for _ in range(12):  # near copies
        words = base.split()
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(99)}"
        out.append(" ".join(words))
    out += [base] * 5 + [prose(rnd, 20) + " " + passage + " " + prose(rnd, 9) for _ in range(8)] + [prose(rnd, 6000)] + ODD
    rnd.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    for name, value in CLASHING.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


# 8 token counts


def test_token_counts(spark, docs, rows, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    got = table(token_counts.token_counts(docs, BYTES, limit=100, memory=50))
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100)
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_merging_arrays_equals_the_library_on_odd_strings():
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "été", "日本語", "123", "!!", "aaaaaaa", "<|endoftext|>", "\x85", "\xa0", "\x1c", "😀", "́", "\r\n", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(BYTES)
    assert token_counts.Counter(BYTES, 100).count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words = packing.WordIds(WORDS, 100)
    tokenizer = Tokenizer.from_file(WORDS)
    assert list(words.encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# 2 packing


def test_packing(spark, docs, rows, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    want = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, p] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.pack(docs, WORDS, max_tokens=256).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(n for _, n, _ in want.values())
    assert len(by) <= -(-total // 256) * 1.03 + 1
    assert packing.pack(empty, WORDS, max_tokens=256).count() == 0


def test_plans_are_complete_and_tight():
    rnd = random.Random(1)
    for size in (256, 512, 4096):  # most lengths are far below the size, so the volume is a tight bound
        h = collections.Counter(min(size, max(1, int(rnd.lognormvariate(np.log(size) - 2, 1)))) for _ in range(4000))
        least = -(-sum(n * c for n, c in h.items()) // size)
        for shape in packing.SHAPES:
            plan = packing.Plan(dict(h), size, *shape)
            used = collections.Counter()
            for content, times in zip(plan.content, plan.times, strict=True):
                assert sum(n * k for n, k in content) <= size
                for n, k in content:
                    used[n] += k * times
            assert used == h and plan.sequences <= least * 1.01 + 1
        best = packing.best_plan(dict(h), size)
        alone = packing.Plan(dict(h), size, 1, 1, 0)  # no pattern has one document: best fit only
        assert alone.patterned == 0 and best.sequences <= alone.sequences
        assert best.patterned >= 0.3 * sum(h.values())
    for h in ({}, {256: 3}, {1: 5}, {129: 4}, {255: 2, 1: 1}):
        assert packing.best_plan(h, 256).sequences == (4 if 129 in h else 2 if 255 in h else sum(n * c for n, c in h.items()) // 256 + (1 in h))


def test_patterns_fill_a_sequence():
    got = packing.patterns([10.0, 30.0, 45.0], 100, 4, 5.0)
    want = {c for k in range(2, 5) for c in itertools.combinations_with_replacement((2, 1, 0), k) if 95 <= sum((10, 30, 45)[i] for i in c) <= 100}
    assert set(got) == want and len(got) == len(want)


def test_nnls_finds_the_nonnegative_fit():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 6)), np.array([0, 2.0, 0, 1.5, 0.3, 0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert (packing.nnls(a, -np.ones(12)) == 0).all()


# 6 substring dedup


def test_substring_dedup(spark, docs, rows, empty):
    first, want = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = substring_dedup.remove_repeats(docs, bucket_chars=2000)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in table(got).items()} == want
    assert sum(n for _, n, _ in want.values()) > 500
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_passages_in_many_steps_are_sent_once_a_task(spark, monkeypatch):
    rnd = random.Random(23)
    passage, other = prose(rnd, 40), prose(rnd, 30)
    rows = [(i, f"{prose(rnd, rnd.randrange(5, 20))} {passage if i % 3 else ''} {prose(rnd, 14)} {other if i % 4 == 1 else ''}") for i in rnd.sample(range(10_000), 240)]
    rows += [(None, passage), (None, passage), (None, None)]
    first, want = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None)):
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # each batch is a step of its own
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = substring_dedup.remove_repeats(docs).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == want
        assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0, 0, 0]
        job = substring_dedup.Dedup(13, 7, 1)
        sent = docs.where("doc_id is not null").coalesce(1).mapInArrow(job.probes, substring_dedup.PROBES).where("length(hashes) > 0").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {tuple(passage.split()[k : k + 7]) for k in range(34)}
    held = collections.Counter(bytes(r["hashes"][5 * k : 5 * k + 5]) for r in sent for k in range(len(r["hashes"]) // 5))
    assert len(sent) >= 60 and sorted(held.values())[-len(words)] <= 12  # of 160 documents in 60 steps


def test_substring_dedup_of_rows_without_or_with_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(None, text), (1, text), (1, text), (2, "a " + text)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 20)]
    with pytest.raises(ValueError):
        substring_dedup.Dedup(12, 7, 1)


def _kept_by_row(rows):
    """Of each row what it loses: windows that start in a row with a smaller id."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_rows_that_share_an_id_lose_their_own_words_only(spark, batch):
    rnd = random.Random(31)
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 30), ("b", 40), ("c", 25)))
    for rows in ([(1, a), (2, a), (2, b)], [(1, a), (2, b), (2, a)], [(1, b), (2, a), (2, b), (2, c), (2, a), (3, f"{c} x {b}"), (3, a)]):
        assert _removed(spark, rows, batch, 1) == sorted(_kept_by_row(rows), key=repr)
    parts = [" ".join(f"p{k}_{i}" for i in range(rnd.choice([13, 20, 50]))) for k in range(12)]
    rows = [(rnd.randrange(12), " ".join([prose(rnd, rnd.randrange(20)), *rnd.sample(parts, rnd.randrange(4)), prose(rnd, rnd.randrange(20))])) for _ in range(150)] + [(3, None), (3, ""), (None, a), (None, b)]
    for parts_ in (1, 4):
        assert _removed(spark, rows, batch, parts_) == sorted(_kept_by_row(rows), key=repr)


def _removed(spark, rows, batch, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).repartition(parts)
        return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 10 Jaccard join


def _shingles(t):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _classes(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if both >= 0.8 * either - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, docs, rows, empty, block):
    got = table(jaccard_join.near_duplicates(docs, block=block))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == _classes(rows)
    if block == 4:
        assert jaccard_join.near_duplicates(empty).count() == 0


def test_rows_without_an_id_have_classes(spark):
    t, u = (" ".join(f"{x}{i}" for i in range(30)) for x in "wu")
    rows = [(None, t), (None, "only here, nowhere else at all"), (4, t), (9, t), (None, t + " z"), (None, u), (None, u), (None, u + " z")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"], r["n_copies"]) for r in got if r["class_id"]) == [(0, 4, 3, 0), (0, 4, 3, 2), (4, 4, 3, 2), (9, 4, 3, 2)]
    assert sorted((r["n_links"], r["n_copies"]) for r in got if not r["class_id"]) == [(0, 0), (2, 0), (2, 1), (2, 1)]
    assert sorted(r["doc_id"] or 0 for r in got if r["first"])[-1] == 4 and sum(r["first"] for r in got) in (3, 4)  # u twice, if its hash is the least


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_of_one_id_are_judged_by_their_texts(spark, turn):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a), (5, b), (2, b + " z"), (3, a + " z"), (1, a), (1, b), (15, c), (15, d), (12, d + " z"), (13, c + " z")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows[::turn], "doc_id bigint, text string").coalesce(1)).collect()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["first"]) for r in got)
    assert got[:6] == [(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (3, 1, 2, False), (5, 1, 2, False), (5, 1, 2, False)]
    assert got[6:] == [(12, 12, 1, True), (13, 13, 1, True), (15, 12, 1, False), (15, 13, 1, False)]


def test_strangers_are_screened_and_pairs_about_the_threshold_found(spark, monkeypatch):
    half = " ".join(f"legal{i}" for i in range(104))
    rows = [(i, half + " " + " ".join(f"w{i}x{k}" for k in range(100))) for i in range(600)] + [(i, " ".join(f"w{i % 5}x{k}" for k in range(100)) + f" {i} " + half) for i in range(900, 905)]
    rnd = random.Random(3)
    for i in range(1000, 1250):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
        changed = list(words)
        for k in rnd.sample(range(0, 160, 8), rnd.randrange(1, 5)):
            changed[k] = "z"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    seen, components = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: seen.append(edges.count()) or components(edges))
    got = table(jaccard_join.near_duplicates(frame(spark, rows)))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == _classes(rows)
    assert sum(r["n_links"] for i, r in got.items() if i < 1000) == 10 and 150 < sum(r["n_links"] for r in got.values()) / 2 < 260
    assert seen[0] < 800  # of 180,000 pairs of strangers and the 250 others, each some times


def test_prefixes_shorten_until_the_recall():
    r = jaccard_join.least_prefix(0.8, 24, 8, 0.9999)
    assert jaccard_join.recall_at(0.8, 24, r) >= 0.9999 > jaccard_join.recall_at(0.8, 24, r + 1)
    assert jaccard_join.least_prefix(0.8, 24, 8, 0.5) == 8
    length = lambda found: jaccard_join.prefix_length(found, 192, 0.8, 24, 8, 4, 0.9999)
    assert length({}) == 4 and length({192: 50.0}) == 8 and length({154: 50.0}) == 5 and length({185: 500.0, 160: 20.0}) == 7


def test_sorted_paths_tell_the_longest_common_prefixes():
    import pyarrow as pa

    rnd, depth = random.Random(9), 8
    rows = sorted((t, int.from_bytes(bytes(rnd.choice([1, 2, 200]) for _ in range(depth)), "big", signed=True), k) for k in range(300) for t in range(2))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("tree", "path", "node"), r, strict=True)) for r in rows[i : i + 37]]) for i in range(0, len(rows), 37)]
    got = {(r["tree"], r["node"]): r["deep"] for b in jaccard_join._matched(depth, 1)(iter(batches)) for r in b.to_pylist()}
    levels = lambda p: (p % 2**64).to_bytes(depth, "big")
    for t, p, k in rows[1:-1]:
        want = max(len(os.path.commonprefix([levels(p), levels(q)])) for u, q, m in rows if u == t and m != k)
        assert got.get((t, k), 0) == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(35)] + [(500, i) for i in range(501, 560)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_sets_that_share_a_hash_stay_apart(spark):
    """With a node hash of 5 bits most sets share their node; the second hash tells them apart."""
    rnd = random.Random(17)
    rows = [(i, prose(rnd, 30)) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]] + [(200 + i, t + " end") for i, t in rows[10:30]]
    want, got = (sorted(map(tuple, jaccard_join.near_duplicates(frame(spark, rows), node_bits=bits).select("doc_id", "class_id", "n_links", "n_copies").collect())) for bits in (64, 5))
    assert got == want and sum(r[2] > 0 for r in want) >= 40


@pytest.mark.parametrize("size", [250, 1000, 1777])
def test_digests_by_slices_equal_whole_ones(size):
    rnd = random.Random(size)
    block = [prose(rnd, n).encode() for n in (0, 3, 40, 300, 900, 2500)] + [b"a" * 5000, b"ab" * 1500 + prose(rnd, 700).encode() + b"z" * 999, "日本語のテキスト、".encode() * 200, bytes(rnd.randrange(256) for _ in range(6000))]
    whole, sliced = fingerprints.Digests(block, 10**9), fingerprints.Digests(block, size)
    assert [whole.text(i) for i in range(len(block))] == [sliced.text(i) for i in range(len(block))]


# 7 decontamination


def test_contaminations(spark, empty):
    rnd = random.Random(6)
    items = [(k, prose(rnd, n)) for k, n in enumerate([14, 20, 35, 59, 11])] + [(90, "too short"), (91, None), (None, prose(rnd, 20))]
    swap = lambda t, n: " ".join("zzz" if k % 8 == 5 and k < 8 * n else w for k, w in enumerate(t.split()))
    hits = {1: (0, items[0][1]), 2: (1, items[1][1].upper()), 3: (2, swap(items[2][1], 4)), 4: (3, " ".join(items[3][1].split()[10:40])), 5: (4, items[4][1])}
    rows = [(i, prose(rnd, 50) + " " + t + " " + prose(rnd, 30)) for i, (_, t) in hits.items()]
    rows += [(6, prose(rnd, 200)), (7, " ".join(items[2][1].split()[:7]) + " " + prose(rnd, 40)), (8, None), (9, ""), (None, items[0][1]), (10, items[0][1]), (10, items[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0)).withColumn("words", F.lit("x"))
    want = {(i, k) for i, (k, _) in hits.items()} | {(10, 0)}
    for most in (1_000_000, 1):
        got = decontamination.contaminations(frame(spark, rows), bench, broadcast_seeds=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert decontamination.contaminations(empty, bench).count() == 0
    assert decontamination.contaminations(frame(spark, rows), bench.limit(0)).count() == 0


def _aligned(doc, item, window=13, equal=10):
    """Every alignment tried, without seeds: (item words, matched, window_matched) or None."""
    d, i = (re.findall(r"[^\W_]+", t.lower()) for t in (doc, item))
    width, found = min(window, len(i)), []
    for shift in range(-len(i) + 1, len(d)) if i else ():
        same = [0 <= shift + k < len(d) and d[shift + k] == w for k, w in enumerate(i)]
        best = max(sum(same[k : k + width]) for k in range(len(i) - width + 1))
        if best * window >= width * equal:
            found.append((sum(same), best))
    return (len(i), max(m for m, _ in found), max(b for _, b in found)) if found else None


def test_every_benchmark_row_counts(spark):
    """Rows that share an item_id, rows without one, and short items of common words."""
    long = " ".join(f"q{i}" for i in range(13))
    bench = spark.createDataFrame([(5, "a a"), (5, long), (None, "zeta eta theta iota"), (6, "the"), (7, None), (7, "the the"), (8, long), (8, long)], "item_id bigint, text string")
    docs = {1: f"x {long} y", 2: "Zeta, eta theta -- iota", 3: "the cat and the dog and the the bird " * 50, 4: "nothing", 5: "a b a"}
    for most in (1_000_000, 0):
        got = decontamination.contaminations(frame(spark, list(docs.items())), bench, broadcast_seeds=most).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["item_words"], r["matched"]) for r in got), key=repr) == sorted([(1, 5, 13, 13), (1, 8, 13, 13), (2, None, 4, 4), (3, 6, 1, 1), (3, 7, 2, 2)], key=repr)
    # a common word as an item is one alignment a text, wherever it stands
    hits = decontamination.contaminated_texts(frame(spark, list(docs.items())), bench)
    assert hits.where("item_words = 1").count() == 1


def test_contaminations_equal_all_alignments(spark):
    rnd = random.Random(8)
    items = {n: " ".join(f"i{n}x{k % 9}" for k in range(n)) for n in range(1, 15)} | {40: " ".join(f"p{k}" for k in range(40))}
    docs = {}

    def add(n, gone, low=0, high=None):
        ws = [f"z{k}" if k in gone else w for k, w in enumerate(items[n].split())][low:high]
        docs[len(docs)] = " ".join(["a b", *ws, "c"])

    for n in range(1, 15):
        for k in range(5):
            for gone in [c for c in itertools.combinations(range(n), k)] if n == 13 and k < 4 else [rnd.sample(range(n), min(k, n)) for _ in range(6)]:
                add(n, gone)
    add(40, range(0, 40, 4))
    add(40, range(2, 40, 4), 5, 30)
    for low in range(0, 13):
        add(14, (), low)
        add(14, (), 0, 14 - low)
    docs[len(docs)] = items[14].split(" ", 3)[3]  # the item hangs over the text's begin
    want = {(i, k, *v) for i, d in docs.items() for k, t in items.items() if (v := _aligned(d, t))}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    for most in (1_000_000, 1):
        got = decontamination.contaminations(frame(spark, list(docs.items())), bench, broadcast_seeds=most).collect()
        assert {(r["doc_id"], r["item_id"], r["item_words"], r["matched"], r["window_matched"]) for r in got} == want and len(got) == len(want)


def test_masks_meet_every_alignment_of_the_rule():
    for n in range(1, 14):
        most = n - -(-n * 10 // 13)
        for gone in itertools.combinations(range(n), most):
            assert any(all(at + k not in gone for k, c in enumerate(m) if c == "1") for m in decontamination.masks_of(n) for at in range(n - len(m) + 1))


# 1 pseudonyms


def _luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_pseudonyms(spark, empty):
    cards = ["4417744280351547", "4417 7442 8035 1547"]
    values = [*cards, "+1 (017) 555-7713", "152.143.123.131", "1984-02-29", "31.12.1999", "12/31/1999", "123-45-6789", "die.55@mail4.example.com", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]
    stay = ["9807915762804490", "999.1.1.1", "1984-02-30", "1.2.3.4.5", "version 2.0", "12345678901234567890123", "0000000000000000", "deadbeef", "000-12-3456", "666-12-3456", "123-00-4567"]
    rows = [(i, f"x {v}, and {v}! ") for i, v in enumerate(values)] + [(100 + i, f"y {v} z") for i, v in enumerate(stay)] + [(200, None), (201, ""), (None, f"<{cards[0]}>"), (202, " ".join(values))]
    got = {r["doc_id"]: r for r in pii.pseudonymise(frame(spark, rows), "k").collect()}
    new = {}
    for i, v in enumerate(values):
        m = re.fullmatch(r"x (.*), and (.*)! ", got[i]["text"])
        assert m and m[1] == m[2] != v and got[i]["n_replaced"] == 2
        new[v] = m[1]
        if "@" not in v and v.count(".") != 3:
            assert re.sub(r"[0-9a-f]", "9", m[1].lower()) == re.sub(r"[0-9a-f]", "9", v.lower())
    assert got[202]["text"] == " ".join(new[v] for v in values)
    assert all(_luhn(re.sub(r"\D", "", new[c])) for c in cards) and new[cards[1]].replace(" ", "") == new[cards[0]] and got[None]["text"] == f"<{new[cards[0]]}>"
    assert all(got[100 + i]["text"] == f"y {v} z" and got[100 + i]["n_replaced"] == 0 for i, v in enumerate(stay))
    assert got[200]["text"] == got[201]["text"] == "" and pii.pseudonymise(empty, "k").count() == 0
    assert pii.pseudonymise(frame(spark, rows[:1]), "other").first()["text"] != got[0]["text"]


def test_long_runs_of_numbers_take_time_by_length(spark):
    began = time.time()
    text = "12 34 " * 20_000 + "4111 1111 1111 1111 05"
    row = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
    assert len(row["text"]) == len(text) and "4111 1111 1111 1111" not in row["text"] and row["text"].endswith(" 05")
    assert time.time() - began < 90


def test_cards_beside_short_numbers_and_phones_without_a_country(spark):
    cards = ["4417744280351547", "4417 7442 8035 1547", "4417-7442-8035-1547", "3782 822463 10005", "4222222222222"]
    phones = ["(017) 555-7713", "017-555-7713", "017 555 7713", "017.555.7713", "1-017-555-7713", "+1 (017) 555-7713"]
    beside = ["{} 123", "{} 05/27", "12 {}", "12 1234 {}", "1234 {} 123 7", "{} {}", "{} 7 {}", "on 1984-02-29 {} 05", "5 {}-123"]
    rows = [(f"{c}#{b}", b.replace("{}", c)) for c in cards for b in [*beside, "{}"]] + [(p, f"call {p}, or {p}.") for p in phones]
    rows += [("date", "4417 7442 8035 1547 1984-02-29"), ("social", "4417 7442 8035 1547 123-45-6789"), ("phone", "017-555-7713 4417 7442 8035 1547"), ("both", "4417 7442 8035 1547 017-555-7713"), ("odd", "44177442 80351547")]
    stay = ["12-017-555-77135", "1234 5678 9012 3456 123", "id-017-555-7713", "10 20 30 40 50 60"]
    rows += [(v, v) for v in stay]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    got = {name: got[i] for i, (name, _) in enumerate(rows)}
    new = {c: got[f"{c}#{{}}"]["text"] for c in cards}
    assert all(new[c] != c and _luhn(re.sub(r"\D", "", new[c])) for c in cards)
    date = pii.pseudonymise(spark.createDataFrame([(0, "1984-02-29")], "doc_id bigint, text string"), "k").first()["text"]
    for c in cards:
        for b in beside:
            r = got[f"{c}#{b}"]
            assert r["text"] == b.replace("{}", new[c]).replace("1984-02-29", date) and r["n_replaced"] == b.count("{}") + b.count("1984"), (c, b, r["text"])
    number = re.sub(r"\D", "", got["(017) 555-7713"]["text"])[:10]
    for p in phones:
        a, b = re.fullmatch(r"call (.*), or (.*)\.", got[p]["text"]).groups()
        assert a == b != p and re.sub(r"\D", "", a)[-10:] == number and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", p)
    c, local = new[cards[1]], got["017-555-7713"]["text"][5:17]
    assert got["date"]["text"] == f"{c} {date}" and got["phone"]["text"] == f"{local} {c}" and got["both"]["text"] == f"{c} {local}"
    assert got["social"]["text"].startswith(c) and "123-45-6789" not in got["social"]["text"] and got["odd"]["text"].replace(" ", "") == new[cards[0]]
    assert all(got[v]["text"] == v and got[v]["n_replaced"] == 0 for v in stay)


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pii.permuted_digits(F.col("d"), "k", "t").alias("x"))
    assert {r["x"] for r in n.collect()} == {f"{i:03d}" for i in range(1000)}
    social = spark.sql("select format_string('%03d-%02d-%04d', id % 898 + if(id % 898 >= 665, 2, 1), id % 99 + 1, id * 7 % 9999 + 1) d from range(3000)").select("d", pii._social(F.col("d"), "k").alias("x")).collect()
    assert len({r["x"] for r in social}) == len({r["d"] for r in social}) == 3000 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", r["x"]) for r in social)
    dates = spark.sql("select date_format(date_add(date'1900-01-01', cast(id as int)), 'yyyy-MM-dd') d from range(0, 73000, 7)")
    moved = dates.select(pii._date(F.col("d"), "k").alias("x")).collect()
    assert len({r["x"] for r in moved}) == len(moved) and all("1900-01-01" <= r["x"] <= "2099-11-13" for r in moved)
    ends = spark.createDataFrame([("0101-03-12",), ("9894-09-09",), ("0101-03-13",), ("9894-09-08",)], "d string").select("d", pii._date(F.col("d"), "k").alias("x")).collect()
    assert [r["d"] == r["x"] for r in ends] == [True, True, False, False]


def _prf(tweak, *parts):
    return int(hashlib.sha256("|".join(["k", tweak, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def _feistel(a, b, mod_a, mod_b, tweak):
    for i in range(10):
        mod = mod_b if i % 2 else mod_a
        a, b = b, (a + _prf(tweak, i, b) % mod) % mod
    return a, b


def _digits(d, kind):
    n, u = len(d), len(d) // 2
    a, b = _feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (n - u), f"{kind}/{n}")
    return f"{a:0{u}d}{b:0{n - u}d}"


def _plain_pseudonym(kind, v):
    """The pseudonym of a value by plain Python."""
    import datetime

    d = re.sub(r"\D", "", v)
    if kind == "card":
        new = _digits(d[:-1], "card")
        new += next(c for c in "0123456789" if _luhn(new + c))
    elif kind == "phone":
        new = d[:-10] + _digits(d[-10:], "phone")
    elif kind == "ip":
        o = [int(x) for x in v.split(".")]
        return ".".join(str(x) for y in _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip") for x in divmod(y, 256))
    elif kind == "social":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        a, b = _feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "social")
        new = f"{a // 99 + 1 + (a // 99 >= 665):03d}{a % 99 + 1:02d}{b + 1:04d}"
    elif kind == "date":
        first = datetime.date(1900, 1, 1)
        block, k = divmod((datetime.date.fromisoformat(v) - first).days, 73000)
        a, b = _feistel(*divmod(k, 292), 250, 292, f"date/{block}" if block else "date")
        return (first + datetime.timedelta(days=block * 73000 + a * 292 + b)).isoformat()
    elif kind == "mail":
        return "u" + hashlib.sha256(f"k|mail|{v.lower()}".encode()).hexdigest()[:24] + v[v.index("@") :]
    elif kind == "hex":
        new = hashlib.sha256(f"k|hex|{v.lower()}".encode()).hexdigest()[: len(v)]
        return new if v == v.lower() else new.upper()
    digits = iter(new)
    return re.sub(r"\d", lambda m: next(digits), v)


def test_pseudonyms_equal_plain_python(spark):
    rnd, values = random.Random(5), []
    for _ in range(40):
        d = "".join(rnd.choice("0123456789") for _ in range(15))
        d = "4" + d[1:] + next(c for c in "0123456789" if _luhn("4" + d[1:] + c))
        values += [("card", d), ("card", "-".join(d[i : i + 4] for i in range(0, 16, 4)))]
        t = [f"{rnd.randrange(1000):03d}", f"{rnd.randrange(1000):03d}", f"{rnd.randrange(10000):04d}"]
        values += [("phone", "-".join(t)), ("phone", f"+1 ({t[0]}) {t[1]}-{t[2]}"), ("ip", ".".join(str(rnd.randrange(256)) for _ in range(4)))]
        values += [("social", f"{rnd.choice([1, 665, 667, 899, rnd.randrange(1, 666)]):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}")]
        values += [("date", f"{rnd.choice([1815, 1899, 1900, 1984, 2099, 2100, 2250]):04d}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}")]
        values += [("mail", f"A.b{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.org"), ("hex", f"{rnd.getrandbits(160):040x}a1"), ("hex", f"{rnd.getrandbits(128):032X}A1")]
    rows = [(i, f"see {v}, or {v} and more") for i, (_, v) in enumerate(values)]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()}
    for i, (kind, v) in enumerate(values):
        new = _plain_pseudonym(kind, v)
        assert got[i] == f"see {new}, or {new} and more", (kind, v)


# 4 sharding


def test_shards(spark, docs, rows, empty):
    got = sharding.shards(docs, limit_bytes=20_000).collect()
    size = {i: len((t or "").encode()) for i, t in rows}
    assert {r["doc_id"]: r["n_bytes"] for r in got} == size
    total, bits = collections.Counter(), {}
    for r in got:
        total[r["shard"]] += r["n_bytes"]
        bits[r["doc_id"]] = bin(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits[r["doc_id"]].startswith(r["shard"]) and len(r["shard"]) == r["depth"]
    under = lambda p: sum(size[i] for i in size if bits[i].startswith(p))
    for s, n in total.items():
        assert n <= 20_000 or len([i for i in size if bits[i].startswith(s)]) == 1
        assert not s or under(s[:-1]) > 20_000  # nothing is split without need
    assert {r["shard_bytes"] == total[r["shard"]] for r in got} == {True}
    assert sharding.shards(empty, 10).count() == 0
    twice = sharding.shards(spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (2, "y"), (None, None)], "doc_id bigint, text string"), 40).collect()
    assert len(twice) == 4 and {r["shard_bytes"] for r in twice if r["doc_id"] == 1} == {100}


# 5 fingerprints


def test_fingerprints(spark, docs, rows, empty):
    got = table(fingerprints.fingerprints(docs, partitions=4))
    order = sorted(rows, reverse=True)
    prints = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        changed = t[: len(t) - m] + n[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        a, b, c = (fingerprints.parse(x) for x in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[order[(k + 1) % len(order)][0]]["fingerprint"]))
        assert got[i]["near_edited"] == fingerprints.likeness(a, b) and got[i]["near_next"] == fingerprints.likeness(a, c)
        if len(t) > 400 and len(set(t)) > 5:
            assert got[i]["near_edited"] > 0.4
    assert fingerprints.fingerprints(empty).count() == 0
    single = fingerprints.fingerprints(spark.createDataFrame([(None, "abc def")], "doc_id bigint, text string")).first()
    assert single["near_next"] == 1.0


def test_entropies_are_those_of_the_windows():
    raw = np.frombuffer(b"the quick brown fox jumps over aaaaaaaaaaaaaaaaaaaaaaaaa the lazy dog, again and again.", np.uint8)
    levels = fingerprints.Digests._levels(raw)
    w = fingerprints.WIDTH
    for i in range(len(raw) - w + 1):
        p = np.bincount(raw[i : i + w])[np.bincount(raw[i : i + w]) > 0] / w
        h = float(-(p * np.log2(p)).sum())
        if h >= fingerprints.LEAST + 1e-6:
            far = abs(h - fingerprints.TYPICAL) / max(fingerprints.TYPICAL, np.log2(w) - fingerprints.TYPICAL)
            assert abs(levels[i] - (1 - far) * (fingerprints.LEVELS - 1)) <= 1
    a = fingerprints.Digests([b"some text that is long enough to have a window or two", b"", b"tiny"])
    assert fingerprints.likeness(a.of(0), a.of(0)) == 1 and fingerprints.likeness(a.of(1), a.of(1)) == 1 and fingerprints.likeness(a.of(0), a.of(1)) == 0


def _plain_digest(raw):
    """Features and bits of a text by plain Python, a window at a time."""
    from math import log2

    w = fingerprints.WIDTH
    mask = 2**64 - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    raw = raw.ljust(w, b"\0") if raw else raw
    windows = [raw[i : i + w] for i in range(len(raw) - w + 1)]
    if not windows:
        return []

    def level(x):
        h = log2(w) - sum(c * log2(c) for c in collections.Counter(x).values()) / w
        far = abs(h - fingerprints.TYPICAL) / max(fingerprints.TYPICAL, log2(w) - fingerprints.TYPICAL)
        return fingerprints.LEVELS if h < fingerprints.LEAST else round((1 - far) * (fingerprints.LEVELS - 1), 9)

    levels = {x: level(x) for x in set(windows)}
    span = fingerprints.neighbours(len(windows))
    many = max(len(windows) - span + 1, 1)
    rare = collections.Counter(min(range(i, min(i + span, len(windows))), key=lambda k: (round(levels[windows[k]]), k)) for i in range(many))
    popular = [k for k in sorted(rare) if rare[k] >= min(fingerprints.POPULAR, many)] or sorted(rare)
    c = [int(x) for x in fingerprints.constants(w // 8, 7)]
    hashes = [mix(sum(mix(int.from_bytes(windows[k][8 * j : 8 * j + 8], "little")) * c[j] for j in range(w // 8)) & mask) for k in popular]
    filters = [hashes[i : i + fingerprints.FILL] for i in range(0, len(hashes), fingerprints.FILL)]
    return [{h >> 11 * k & fingerprints.BITS - 1 for h in part for k in range(fingerprints.HASHES)} for part in filters]


def _plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def score(x, y):
        n, m = len(x) / fingerprints.BITS, len(y) / fingerprints.BITS
        chance = n * m * fingerprints.BITS
        chance += 2 * (chance * (1 - n) * (1 - m)) ** 0.5
        return min(1, max(0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9)))

    one = lambda p, q: sum(len(x) * max(score(x, y) for y in q) for x in p) / sum(map(len, p))
    return (one(a, b) + one(b, a)) / 2


def test_digests_equal_plain_python():
    rnd = random.Random(7)
    texts = ["", "tiny", "sixteen bytes ok", prose(rnd, 12), prose(rnd, 30), prose(rnd, 60), prose(rnd, 3000), "x" * 400, "日本語 " * 50 + prose(rnd, 40), prose(rnd, 200)]
    texts += [fingerprints.edited(t, texts[k - 1]) for k, t in enumerate(texts)]
    d = fingerprints.Digests([t.encode() for t in texts])
    plain = [_plain_digest(t.encode()) for t in texts]
    bits = lambda f: set(np.flatnonzero(np.unpackbits(f)).tolist())
    for i, p in enumerate(plain):
        assert [bits(f) for f in d.of(i)] == p, texts[i][:40]
    for i in range(len(texts)):
        for j in range(i, len(texts)):
            assert abs(fingerprints.likeness(d.of(i), d.of(j)) - _plain_likeness(plain[i], plain[j])) < 1e-9


# 9 main text


PARA = "A long, plain paragraph of text, with commas, that goes on for a while and says something."


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain  text\nonly", "plain text only"),
        ("<p>a<p>b <b>c</b>d", "a b cd"),
        (f"<nav><a href=x>m</a></nav><div class='ad'>{PARA}</div><article><h1>T</h1><p>{PARA}<p>x &lt;b&gt; &#233;&nbsp;y</article><footer>f</footer>", f"T {PARA} x <b> é y"),
        (f"<body><div id=main><p>{PARA}</p><p>Second.</p></div><div class='sidebar'><p>{PARA}</p></div><ul><li><a href=x>one</a></li></ul><div class='comments'><p>{PARA}</p></div>", f"{PARA} Second."),
        (f"<div><p>{PARA}</p></div><form><p>{PARA}</p></form><script>var t='</p>'</script><style>p{{}}</style><!-- <p>no</p> -->", PARA),
        ("1 < 2 and <a href=\"x>y", "1 < 2 and <a href=\"x>y"),
        (f"<article><p>{PARA}<br>more<div class='share newsletter'>no</div><article class=comment><p>no</p></article></article>", f"{PARA} more"),
    ],
)
def test_main_text(spark, html, want):
    pages = spark.createDataFrame([(1, None, html)], "page_id bigint, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    r = main_text.extract_main_text(pages).first()
    assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), None)
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "begin, end",
    [(f"<div {a}>", "</div>") for a in ("class='content has-sidebar'", "class=no-sidebar", "class='page with-banner'", "id='share-price-report'", "class=promo")]
    + [("<article class='post comments-open'>", "</article>"), ("<body class='comments-enabled'>", "</body>"), ("<div class=banner><div id=share-x>", "</div></div>"), ("<div class=related><main>", "</main></div>")],
)
def test_wrappers_with_boilerplate_words_keep_their_article(begin, end):
    aside = "<div class='sidebar'><p>Other news, not of this page.</p></div>"
    assert main_text.main_text(f"{begin}<h1>T</h1><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p>{aside}<div class=comments><p>no</p></div>{end}") == f"T {PARA} {PARA} {PARA}"
    long = f"<div id=comments>{f'<div class=comment><p>{PARA}</p></div>' * 40}</div>"
    assert main_text.main_text(f"<div><p>{PARA}</p></div>{long}{aside}") == PARA


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><form action=x><div class=menu><a href=a>m</a></div><div id=main><h1>T</h1><p>{PARA}</p><p>{PARA}</p></div><input type=hidden></form></body>", f"T {PARA} {PARA}"),
        (f"<div id=main><section><h2>A</h2><p>{PARA}</p><p>{PARA}</p></section><section><h2>B</h2><p>short.</p></section></div>", f"A {PARA} {PARA} B short."),
        (f"<header><a href=x>Site</a></header><article><header><h1>Title</h1></header><p>{PARA}</p><footer>f</footer></article>", f"Title {PARA}"),
        (f"<body><nav><a href=x>m</a></nav><h1>Title</h1><article><p>{PARA}</p></article></body>", f"Title {PARA}"),
        (f"<title>Not this</title><div><p>{PARA}</p><p style='display: none'>{PARA}</p><p hidden>no</p></div>", PARA),
        (f"<body><h1>Site</h1><div class=x><h2>Head</h2><p>{PARA}</p><p>{PARA}</p></div></body>", f"Head {PARA} {PARA}"),
        (f"<div class=post><p>{PARA}</p></div><div class=post><p>{PARA}</p><p>{PARA}</p></div><div class=links><p><a href=x>{PARA}</a></p></div>", f"{PARA} {PARA} {PARA}"),
    ],
)
def test_main_text_of_usual_layouts(html, want):
    assert main_text.main_text(html) == want


def _page(rnd, k):
    """A page without <article>, and its text."""
    words = lambda n: " ".join(rnd.choice(["stone", "river", "light", "old", "house", "walks,", "a", "the", "of", "and", "grows"]) for _ in range(n))
    para = lambda: words(rnd.randrange(15, 90)) + "."
    head, blocks = f"Head {k}", []
    for _ in range(rnd.randrange(2, 12)):
        kind = rnd.random()
        if kind < 0.7:
            blocks.append(("<p>{}" + rnd.choice(["", "</p>"]), [para()]))
        elif kind < 0.8:
            blocks.append(("<h2>{}</h2>", [words(3)]))
        elif kind < 0.9:
            items = [words(5) for _ in range(3)]
            blocks.append(("<ul>" + "<li>{}" * 3 + "</ul>", items))
        else:
            blocks.append(("<blockquote><p>{}</p></blockquote>", [para()]))
    blocks += [("<p>{}</p>", [para()]), ("<p>{}</p>", [para()])]
    notice = lambda: rnd.choice([f"<div class='ad'>{words(20)}</div>", f"<aside><p>{para()}</p></aside>", f"<div class='share-buttons'><a href=s>Share</a> {words(2)}</div>", "<script>var x = '<p>no</p>';</script>", f"<form><label>{words(3)}</label><input></form>", f"<div id=newsletter><p>{words(12)}</p></div>", ""])
    body = f"<h1>{head}</h1>" + "".join(t.format(*x) + (notice() if rnd.random() < 0.2 and "{}</p>" in t else "") for t, x in blocks)
    body = rnd.choice(["<div id=content>{}</div>", "<div class='post-body wide'>{}</div>", "<main>{}</main>", "<div class='layout has-sidebar'><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<div class='page-with-banner'><section>{}</section></div>"]).replace("{}", body)
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{words(1)}</a></li>" for i in range(rnd.randrange(3, 12))) + "</ul>"
    before = rnd.choice([f"<div class=menu>{menu}</div>", f"<nav>{menu}</nav>", f"<header><p>{words(6)}</p>{menu}</header>", f"<div id=header>{menu}</div>"]) + rnd.choice(["", f"<div class='cookie-notice'><p>{para()}</p></div>", f"<div role=dialog>{words(20)}</div>"])
    side = rnd.choice(["", f"<div class=sidebar><p>{para()}</p>{menu}</div>", f"<aside>{menu}<p>{para()}</p></aside>"])
    comments = rnd.choice(["", "<div id=comments>" + "".join(f"<div class=comment><p>{para()}</p></div>" for _ in range(rnd.randrange(1, 30))) + "</div>"])
    foot = rnd.choice([f"<footer>{words(9)}</footer>", f"<div class=footer><p>{words(15)}</p></div>"])
    page = f"<html><head><title>{head} | Site</title><style>p{{}}</style></head><body>{before}{side}{body}{comments}{foot}</body></html>"
    if rnd.random() < 0.2:
        page = page.replace("<body>", "<body class='comments-enabled'><form action=/ method=post>").replace("</body>", "</form></body>")
    return page, " ".join([head, *(x for _, xs in blocks for x in xs)])


def test_main_text_of_made_pages_without_an_article():
    rnd = random.Random(12)
    wrong = []
    for k in range(400):
        page, want = _page(rnd, k)
        if main_text.main_text(page) != want:
            wrong.append((page, want, main_text.main_text(page)))
    assert len(wrong) <= 4, wrong[0]


def test_main_text_takes_time_by_length():
    import time

    def seconds(source):
        t = time.process_time()
        main_text.main_text(source)
        return time.process_time() - t

    for unit in ("<div></p>", "<li><div>", "<div><p>a", "<p>a, b", "<b><div></b>", "<td>x"):
        assert seconds(unit * 40_000) < 12 * max(seconds(unit * 8_000), 0.05)


@pytest.mark.parametrize("unit", ["<a ", "<script ", '<p title="', "<p '", "<p style=a>", "<!-- ", "<aaa", "<script></script ", "&amp"])
def test_broken_markup_takes_time_by_length(unit):
    article = "<article><p>" + "Some prose, with commas, here. " * 20 + "</p></article>"
    began = time.time()
    assert main_text.main_text(article + unit * (1_000_000 // len(unit))).startswith("Some prose, with commas, here.")
    main_text.main_text(unit * (1_000_000 // len(unit)) + article)
    assert time.time() - began < 30


def test_tokens_of_any_markup_equal_one_pattern():
    """Tokens against one pattern for all markup, which tries the rest of the page at each open quote."""
    whole = re.compile(
        r"<!--(?:.*?-->|.*)|<(?P<raw>script|style|noscript|template|textarea|iframe)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
        re.S | re.I,
    )
    rnd = random.Random(1)
    parts = ["<a ", "<p>", "</p>", "<!--", "-->", "<script ", "<script>", "</script>", "</script ", ">", "'", '"', 'title="', "x", "<", " ", "/", "<!doctype", "<textarea>", "<b", "a='", "</A>"]
    for _ in range(5000):
        page = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert list(main_text.tokens(page)) == [(t.start(), t.end(), (t["tag"] or "").lower(), bool(t["end"]), t["attrs"] or "") for t in whole.finditer(page)], page


def test_headlines_in_headers_equal_sections_and_topics():
    prose = "A sentence with some words, and a comma, and more of it to read. " * 4
    assert main_text.main_text(f"<body><header><h1>Headline</h1></header><div><p>{prose}</p><p>{prose}</p></div></body>").startswith("Headline A sentence")
    assert "Site" not in main_text.main_text(f"<body><header><h1>Site</h1><a href='/'>home</a></header><div><p>{prose}</p><p>{prose}</p></div></body>")
    sections = "".join(f"<div><div><p>{k} {prose}</p></div></div>" for k in ("one", "two", "three"))
    text = main_text.main_text(f"<body><nav><a href='/'>home</a></nav><div>{sections}</div></body>")
    assert all(k in text for k in ("one A", "two A", "three A")) and "home" not in text
    text = main_text.main_text(f"<article><p>{prose}</p><section id='social-impact'><p>Impact {prose}</p></section><div class='social-share'>Share this</div><div class='alert'>Beware</div></article>")
    assert "Impact A" in text and "Share" not in text and "Beware" not in text


def test_pages_with_repeats_long_ones_and_clashing_columns(spark):
    long = "<div>" + f"<p>{PARA}</p>" * 20_000 + "</div>"
    rows = [(1, "u", f"<p>{PARA}</p>"), (1, "u", f"<p>{PARA}</p>"), (2, None, long), (None, "v", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x")).withColumn("tags", F.lit(0))
    got = main_text.extract_main_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, len(PARA)), (1, len(PARA)), (2, 20_000 * (len(PARA) + 1) - 1)]


# 3 quality


def test_quality_on_held_out_rows(spark, empty):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        good = rnd.random() < 0.7
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 200))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" if rnd.random() < 0.7 else w for w in words)))
        if i % 3:
            labels.append((i, int(good)))
    truth = {i: "!!" not in t for i, t in rows}
    rows += [(2000, None), (2001, ""), (None, "w1 w2")]
    lab = spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id bigint, quality int").withColumn("y", F.lit(1))
    got = quality.quality_scores(frame(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 100 and sum(truth[r["doc_id"]] == bool(r["predicted"]) for r in tested) >= 0.97 * len(tested)
    assert {r["score"] for r in quality.quality_scores(frame(spark, rows[:5]), lab.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, lab).count() == 0


def test_scores_equal_plain_ridge_and_isotonic(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{rnd.randrange(30)}" + "!" * (rnd.random() < i % 7 / 9) for _ in range(rnd.randrange(5, 60)))) for i in range(300)]
    labels = {i: int(rnd.random() < 0.2 + 0.1 * (i % 7)) for i in range(0, 300, 2)}
    got = table(quality.quality_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")))
    x = np.array([quality.statistics(t) for _, t in rows])
    known = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    y = np.array([labels[i] for i in known], float)
    scale = x[known].std(axis=0)
    model = quality.Model(x[known].mean(axis=0), np.where(scale > 0, scale, 1.0))
    f = model.features(x)
    # the same ridge as one weighted least-squares problem with the penalty as further rows
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a = np.vstack([f[known] * np.sqrt(share)[:, None], np.sqrt(quality.PENALTY) * np.eye(f.shape[1])])
    raw = f @ np.linalg.lstsq(a, np.append(y * np.sqrt(share), np.zeros(f.shape[1])), rcond=None)[0]
    bins = np.rint(raw[known] * quality.BINS)
    grid = np.unique(bins)
    n, total = np.array([(bins == b).sum() for b in grid], float), np.array([y[bins == b].sum() for b in grid])
    # isotonic regression by its min-max formula
    level = [max(min(total[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(grid))) for i in range(k + 1)) for k in range(len(grid))]
    want = np.interp(raw, grid / quality.BINS, level)
    assert sum(abs(got[i]["score"] - want[i]) < 1e-6 for i in range(300)) >= 297  # a raw score may round to the next bin


def test_isotonic_pooling():
    y, w = np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.2]), np.array([1, 1, 1, 2, 1, 3.0])
    p = quality.pool(np.arange(6), y, w)
    assert (np.diff(p) >= 0).all() and np.isclose(p @ w, y @ w)


# all that read documents


def test_repeated_rows_null_ids_and_long_texts(spark, monkeypatch):
    rnd = random.Random(14)
    long = prose(rnd, 60_000, 30_000)  # longer than a step
    card = "4417744280351547"
    rows = [(1, "one " + card), (1, "one " + card), (1, "other text"), (None, "one " + card), (None, None), (None, None), (2, long), (3, long + " x"), (4, ""), (4, None)]
    docs = frame(spark, rows, 3)
    known = lambda df: sorted(((r["doc_id"] or 0) for r in df.collect()))
    ids = sorted(i or 0 for i, _ in rows)
    named = pii.pseudonymise(docs, "k").collect()
    assert sorted(r["doc_id"] or 0 for r in named) == ids and len({r["text"] for r in named if r["n_replaced"]}) == 1 and sum(r["n_replaced"] for r in named) == 3
    packed = packing.pack(docs, WORDS, max_tokens=4096).collect()
    assert sorted(r["doc_id"] or 0 for r in packed if r["piece"] == 0) == ids and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    n = len(Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in packed if r["doc_id"] == 2) == n and sum(r["doc_id"] == 2 for r in packed) == -(-n // 4096)
    counted = token_counts.token_counts(docs, BYTES).collect()
    assert sorted(r["doc_id"] or 0 for r in counted) == ids and next(r["n_tokens"] for r in counted if r["doc_id"] == 2) == len(Tokenizer.from_file(BYTES).encode(long, add_special_tokens=False).ids)
    scored = quality.quality_scores(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, 1)], "doc_id bigint, quality int")).collect()
    assert sorted(r["doc_id"] or 0 for r in scored) == ids and len({r["score"] for r in scored if r["text_hash"] == next(x["text_hash"] for x in scored if x["doc_id"] is None)}) == 1
    prints = fingerprints.fingerprints(docs, partitions=3).collect()
    assert sorted(r["doc_id"] or 0 for r in prints) == ids and len({r["fingerprint"] for r in prints}) in (4, 5)  # one more word need not change a long text's
    assert max(r["near_next"] for r in prints if r["doc_id"] == 3) > 0.95
    assert known(sharding.shards(docs, 100_000)) == ids
    removed = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in removed if r["n_removed"]) == [(3, 60_000)]
    found = decontamination.contaminations(docs, spark.createDataFrame([(9, " ".join(long.split()[500:530]))], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_words"], r["matched"]) for r in found) == [(2, 30, 30), (3, 30, 30)]
    classes = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in classes) == [(0, 1, 2), (0, 4, 3), (0, 4, 3), (1, 1, 0), (1, 1, 2), (1, 1, 2), (2, 2, 1), (3, 2, 1), (4, 4, 3), (4, 4, 3)]


# pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "near_dedup":
            texts = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert ids == {i for i, (root, _) in _classes(texts).items() if i == root}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}


def test_pipeline_of_odd_tables_against_plain_python(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "KEY", "k")
    rnd = random.Random(21)
    item, card = prose(rnd, 20), "4417744280351547"
    good = [prose(rnd, rnd.randrange(30, 90)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(rnd, 40).split())) for i in range(40)]  # of low quality
    rows += [(200, good[0] + " z"), (201, good[1] + " z"), (3, good[3]), (None, good[4]), (None, good[5] + " z"), (None, "only without an id " + good[6]), (None, "only without an id " + good[6]), (7, "another text of seven " + prose(rnd, 30))]
    rows += [(210, prose(rnd, 20) + " " + item), (None, prose(rnd, 25) + " " + item), (8, prose(rnd, 30) + " " + item), (211, f"{good[9]} {card} {good[10]}"), (220, None), (221, ""), (222, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("n"))
    docs.withColumn("text_hash", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 60)) for i in range(140) if i < 60 or i >= 100]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = collections.Counter(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == list(corpus_pipeline.COLUMNS)
        got = collections.Counter((r["doc_id"], r["text"]) for r in now.collect())
        if name == "quality":
            assert got == collections.Counter({k: n for k, n in left.items() if (k, n) in got.items()}) and len([k for k in got if "!!" in (k[1] or "")]) <= 4 and len(left) - len(got) < 45
        elif name == "near_dedup":
            sets = {k: _shingles(k[1]) for k in left}
            root = {k: k for k in left}
            find = lambda k: k if root[k] == k else find(root[k])
            for a, b in itertools.combinations(left, 2):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    root[find(b)] = find(a)
            classes = collections.defaultdict(list)
            for k in left:
                classes[find(k)].append(k)
            assert set(got.values()) == {1} and len(got) == len(classes)
            for held in classes.values():
                (one,) = [k for k in held if k in got]
                assert one[0] == min((k[0] for k in held if k[0] is not None), default=None)
        elif name == "decontaminate":
            assert got == collections.Counter({k: n for k, n in left.items() if not _aligned(k[1] or "", item)})
        else:
            new = _plain_pseudonym("card", card)
            assert got == collections.Counter({(i, (t or "").replace(card, new)): n for (i, t), n in left.items()}) and any(new in k[1] for k in got)
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        left = got
    tokenizer = Tokenizer.from_file(WORDS)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["length"]) for r in packed) == collections.Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_word_ids_merge_a_part_once(monkeypatch):
    """Parts that other words had are not merged again, ids are the library's, and the memory stays within its bound."""
    words, merged = packing.WordIds(WORDS, 100), []
    encode = words.bpe.encode
    monkeypatch.setattr(words.bpe, "encode", lambda parts: merged.extend(parts) or encode(parts))
    lines = ["House house, HOUSE! (house) don't don", "house; Don't x2 don. naïve naïve, a<|b '' 's", "house\x00 don\x7f a\x01b"]
    for line in lines:
        assert list(words.encode([line])) == [np.array(words.tokenizer.encode(line, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(merged) == len(set(merged)) and b"house" in merged
    for i in range(300):
        list(words.encode([f"w{i} house"]))
    assert len(words.known.new) + len(words.known.old) <= 110 and merged.count(b"house") <= 1
