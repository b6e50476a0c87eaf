"""Operators that split large groups, against plain loops over whole groups."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stillwright.functions.numbers import rounded
from stillwright.operators import selection
from stillwright.operators.frames import merged_tiles, tile_coords
from stillwright.operators.greedy import Clusters, greedy_clusters, suppressed, with_chains
from stillwright.operators.matching import hash_parts, near_hashes, nearest, parts_for
from stillwright.operators.ranking import carried


def _one_by_one(vectors, threshold):
    state = Clusters()
    return [state.place(v, threshold) for v in vectors], state


@pytest.mark.parametrize("noise, threshold, batch", [(0.08, 0.5, 10_000), (0.4, 0.35, 999), (2.0, 0.2, 64)])
def test_clusters_by_blocks_equal_one_by_one(noise, threshold, batch):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(30, 32))
    vectors = centres[rnd.integers(0, 30, 12_000)] + rnd.normal(size=(12_000, 32)) * noise * np.sqrt(32) / 4
    vectors[::37] = vectors[0]  # ties
    vectors[5], vectors[4000] = 0, 0
    want, one = _one_by_one(vectors, threshold)
    blocks = Clusters()
    got = np.concatenate([blocks.place_all(vectors[i : i + batch], threshold) for i in range(0, len(vectors), batch)])
    assert got.tolist() == want and (blocks.sums[: blocks.n] == one.sums[: one.n]).all()
    assert noise > 0.1 or blocks.steps * 5 < len(vectors)


def test_clusters_of_groups_that_cross_batches(spark):
    rnd = np.random.default_rng(4)
    rows = [(g, i, rnd.normal(size=4).tolist()) for g in range(5) for i in range(60)] + [(None, i, rnd.normal(size=4).tolist()) for i in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = greedy_clusters(spark.createDataFrame(rows, "g int, i int, v array<double>"), "g", "i", "v", 0.4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (None, *range(5)):
        want, _ = _one_by_one([np.array(v) for k, _, v in rows if k == g], 0.4)
        assert [r["cid"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])] == want


def _suppressed(rows, gap):
    picks = []
    for item, score, sec in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(sec - s) >= gap for _, s in picks):
            picks.append((item, sec))
    return [i for i, _ in picks]


@pytest.mark.parametrize("gap", [1, 7, 40])
def test_chains_split_a_user_without_changing_the_picks(spark, gap):
    rnd = random.Random(gap)
    rows = [(0, i, round(rnd.random(), 3), rnd.randrange(30_000)) for i in range(4000)]  # one large user
    rows += [(u, 10_000 + 100 * u + i, round(rnd.random(), 1), rnd.randrange(300)) for u in range(1, 30) for i in range(40)]
    rows += [(None, 90_000 + i, rnd.random(), rnd.randrange(5000)) for i in range(200)]
    df = spark.createDataFrame(rows, "u bigint, i bigint, s double, sec bigint")
    got = suppressed(df, "u", "i", "s", "sec", gap).collect()
    for u in {r[0] for r in rows}:
        mine = sorted((r["pick"], r["i"]) for r in got if r["u"] == u)
        assert [i for _, i in mine] == _suppressed([r[1:] for r in rows if r[0] == u], gap) and [p for p, _ in mine] == list(range(len(mine))), u
    chains = with_chains(df, "u", "sec", gap)
    secs = sorted({r[3] for r in rows if r[0] == 0})
    assert chains.where("u = 0").select("_chain").distinct().count() == 1 + sum(b - a >= gap for a, b in zip(secs, secs[1:]))
    if gap < 40:
        assert chains.where("u = 0").repartition(4, "u", "_chain").select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("gap, distance, most, batch", [(0, 20, None, "10000"), (30, 20, None, "10000"), (30, 14, 9, "61"), (400, 2, None, "300")])
def test_blocks_of_candidates_are_taken_like_one_by_one(spark, gap, distance, most, batch):
    rnd = random.Random(gap + distance)
    codes = [rnd.getrandbits(64) for _ in range(30)]
    rows = [(u, 1000 * (u or 9) + i, round(rnd.random(), 2), rnd.randrange(4000), rnd.choice(codes) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(12)))) for u in (0, 1, 2, None) for i in range(700)]
    signed = [(*r[:4], r[4] - 2**64 if r[4] >= 2**63 else r[4]) for r in rows] + [(0, -1, 9.0, None, 1), (0, -2, 9.0, 5, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = suppressed(spark.createDataFrame(signed, "u bigint, i bigint, s double, sec bigint, h bigint"), "u", "i", "s", "sec", gap, "h", distance, most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in (0, 1, 2, None):
        picks = []
        for _, i, _, sec, code in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[2], r[1])):
            if (most is None or len(picks) < most) and all((gap == 0 or abs(sec - s) >= gap) and (code ^ c).bit_count() >= distance for _, s, c in picks):
                picks.append((i, sec, code))
        assert [i for _, i in sorted((r["pick"], r["i"]) for r in got if r["u"] == u)] == [p[0] for p in picks], u


def test_values_are_carried_over_partitions(spark):
    rnd = random.Random(9)
    rows = [(g, t, rnd.randrange(100) if rnd.random() < 0.02 else None) for g in ("a", "b", None) for t in range(1500 if g == "a" else 40)]
    got = {(r["g"], r["t"]): (r["v"], r["n"]) for r in carried(spark.createDataFrame(rows, "g string, t int, v int"), ["g"], ["t"], "v", "n").collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        mine = [(t, v) for k, t, v in rows if k == g]
        for at, (t, _) in enumerate(mine):
            before, after = [v for _, v in mine[: at + 1] if v is not None], [v for _, v in mine[at:] if v is not None]
            assert got[g, t] == (before[-1] if before else None, after[0] if after else None)


def test_nearest_of_a_group_equals_a_scan(spark):
    rnd = random.Random(12)
    items = [(i, rnd.choice("ab"), rnd.randrange(2000)) for i in range(300)] + [(900, "a", None)]
    pins = [(i, rnd.choice("abc"), rnd.randrange(-500, 2500)) for i in range(200)] + [(999, "a", None)]
    got = {r["p"]: (r["i"], r["distance"]) for r in nearest(spark.createDataFrame(pins, "p int, g string, at int"), spark.createDataFrame(items, "i int, g string, s int"), "p", "at", "i", "s", group=["g"]).collect()}
    want = {p: min((abs(s - at), i) for i, k, s in items if k == g and s is not None)[::-1] for p, g, at in pins if at is not None and g != "c"}
    assert got == want


def _covered(frames, n_roles, n, gap, distance):
    """frames: (frame, score, sec, roles, code), in the order of their scores."""
    fits = lambda f, picks: all(abs(f[2] - p[2]) >= gap and (f[4] ^ p[4]).bit_count() >= distance for p in picks)
    picks = []
    for f in frames:
        if len(picks) < n and fits(f, picks):
            picks.append(f)
    for want in range(n_roles):
        if any(want in p[3] for p in picks):
            continue
        for f in frames:
            if want in f[3] and f not in picks and fits(f, picks[:-1]):
                picks = [*picks[:-1], f]
                break
    return [p[0] for p in sorted(picks, key=lambda p: (-p[1], p[0]))]


def test_coverage_of_role_sets_equals_a_loop(spark):
    rnd, rows = random.Random(21), []
    for v in range(60):
        codes = [rnd.getrandbits(63) for _ in range(5)]
        for k in range(rnd.randrange(1, 40)):
            roles = [r for r in range(5) if rnd.random() < (0.05, 0.2, 0.4)[v % 3]]
            rows.append((v, 100 * v + k, round(rnd.random(), 2), rnd.randrange(400), roles, rnd.choice(codes) ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(0, 14)))))
    df = spark.createDataFrame(rows, "v bigint, f bigint, score double, sec bigint, roles array<int>, code bigint").withColumn("mask", selection.role_mask(F.col("roles")))
    found, repaired = {}, 0
    for r in selection.covering(df, "v", "f", "mask", 4, 4, 20, "code", 12).collect():
        found.setdefault(r["v"], []).append((r["idx"], r["f"]))
    for v in range(60):
        mine = sorted(((f, s, sec, set(roles), code) for x, f, s, sec, roles, code in rows if x == v), key=lambda t: (-t[1], t[0]))
        want = _covered(mine, 4, 4, 20, 12)
        assert [f for _, f in sorted(found[v])] == want, v
        repaired += want != _covered(mine, 0, 4, 20, 12)
    assert repaired > 10


@pytest.mark.parametrize("parts, hot", [(None, 10_000), (3, 10_000), (4, 3), (3, 2)])
def test_near_hashes_with_crowded_parts(spark, parts, hot):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    codes = [base ^ (rnd.getrandbits(22) << 42) for _ in range(25)] + [base ^ rnd.getrandbits(20) for _ in range(25)]  # share parts
    codes += [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 13))) for c in codes] + [codes[0]] * 5
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    want = {(i, j, (codes[i] ^ codes[j]).bit_count()) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() < 12}
    got = near_hashes(spark.createDataFrame([*enumerate(signed), (999, None)], "k bigint, h bigint"), "k", "h", 12, parts, hot).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 40
    df = spark.createDataFrame([*enumerate(signed)], "k bigint, h bigint")
    assert near_hashes(df, "k", "h", 0).count() == 0 and {tuple(r) for r in near_hashes(df, "k", "h", 1).collect()} == {t for t in want if t[2] == 0}


def test_parts_of_hashes_cover_the_distance():
    for distance in range(1, 33):
        for parts in range(1, 9):
            found = hash_parts(distance, parts)
            assert sum(r + 1 for _, _, r in found) == distance and sum(w for _, w, _ in found) <= 64
    compared = lambda n: sum(sum(__import__("math").comb(w, k) for k in range(r + 1)) / 2**w for _, w, r in hash_parts(12, parts_for(12, n)))
    assert compared(10**8) < 1 / 500


def test_merged_tiles_equal_planes(spark):
    rnd = np.random.default_rng(6)
    sizes = [(1, 70, 150), (2, 64, 64), (3, 30, 200), (4, 161, 90)]
    images = spark.createDataFrame(sizes, "k bigint, h int, w int")
    tiles = [(r["k"], r["y"], r["x"], rnd.integers(-40, 300, 64 * 64).tolist()) for r in tile_coords(images, "k", "h", "w", F.lit(64), 16).collect()]
    df = spark.createDataFrame(tiles, "k bigint, y int, x int, values array<int>").join(images, "k")
    got = {(r["k"], r["y"]): r["values"] for r in merged_tiles(df, "k", 64, 16).collect()}
    ramp = np.minimum(17, np.minimum(np.arange(1, 65), np.arange(64, 0, -1)))
    for k, h, w in sizes:
        total, weight = np.zeros((h + 80, w + 80)), np.zeros((h + 80, w + 80))
        for _, y, x, values in [t for t in tiles if t[0] == k]:
            total[y : y + 64, x : x + 64] += np.array(values).reshape(64, 64) * np.outer(ramp, ramp)
            weight[y : y + 64, x : x + 64] += np.outer(ramp, ramp)
        want = np.rint(np.clip(total / np.maximum(weight, 1e-6), 0, 255))[:h, :w]
        assert (np.array([got[k, y] for y in range(h)]) == want).all()
    assert len(got) == sum(h for _, h, _ in sizes)


def test_merged_tiles_make_cells_where_they_merge(spark):
    """Cells that a function makes merge like given ones; no cell is shuffled, and rows leave as what is asked of them."""
    tiles = tile_coords(spark.createDataFrame([(1, 70, 150), (2, 64, 64), (4, 161, 90), (5, 49, 65)], "k bigint, h int, w int"), "k", "h", "w", F.lit(64), 16)
    tiles = tiles.join(spark.createDataFrame([(1, 70, 150), (2, 64, 64), (4, 161, 90), (5, 49, 65)], "k bigint, h int, w int"), "k")

    def cells(k, y, x, first, rows, columns):
        return (k * 7 + y * 3 + x * 5 + np.arange(first, first + rows)[:, None] * 13 + np.arange(columns) * 17) % 301 - 20

    given = F.transform(F.sequence(F.lit(0), F.lit(64 * 64 - 1)), lambda n: ((F.col("k") * 7 + F.col("y") * 3 + F.col("x") * 5 + F.floor(n / 64) * 13 + n % 64 * 17) % 301 - 20).cast("int"))
    want = {(r["k"], r["y"]): (len(r["values"]), sum(r["values"])) for r in merged_tiles(tiles.withColumn("values", given), "k", 64, 16).collect()}
    made = merged_tiles(tiles, "k", 64, 16, cells=cells, lines=("n long, total long", lambda v: [np.full(len(v), v.shape[1]), v.astype(np.int64).sum(axis=1)]))
    assert {(r["k"], r["y"]): (r["n"], r["total"]) for r in made.collect()} == want
    assert "array<" not in made._jdf.queryExecution().executedPlan().toString() and "values" not in made.columns


def test_rounded_as_sql_rounds(spark):
    """Doubles next to halves of the tenth decimal, of scores and of their negatives, at nine and three decimals."""
    rnd = np.random.default_rng(9)
    half = (rnd.integers(0, 2 * 10**9, 4000) * 10 + 5) / 1e10
    values = np.concatenate([half, np.nextafter(half, 0), np.nextafter(half, 9), -half, half * 1.6, [0.0, 1.0005, 0.4999, 2.5e-10]]).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*values, None])], "i int, x double").select("i", "x", rounded("x", 9).alias("a"), rounded(F.col("x"), 3).alias("b"), F.round("x", 9).alias("text"))
    got = df.orderBy("i").collect()
    con = duckdb.connect()
    con.register("v", pa.table({"i": range(len(got)), "x": pa.array([r["x"] for r in got], pa.float64())}))
    want = con.sql("SELECT round(x, 9) AS a, round(x, 3) AS b FROM v ORDER BY i").fetchall()
    assert [(r["a"], r["b"]) for r in got] == want
    assert any(r["text"] != a for r, (a, _) in zip(got, want, strict=True))


@pytest.mark.parametrize("distance", [16, 18])
def test_near_hashes_by_blocks(spark, monkeypatch, distance):
    """Wide distances are compared by blocks: all pairs, those of several blocks and of crowded hashes too."""
    from stillwright.operators import matching

    rnd = np.random.default_rng(4)
    hashes = rnd.integers(0, 2**64, 300, dtype=np.uint64)
    hashes = np.concatenate([hashes, hashes[:200] ^ (np.uint64(1) << rnd.integers(0, 64, 200, dtype=np.uint64)), np.repeat(hashes[:3], 40)])
    for i in range(12):
        hashes[300:350] ^= np.uint64(1) << rnd.integers(0, 64, 50, dtype=np.uint64)
    apart = np.bitwise_count(hashes[:, None] ^ hashes[None, :])
    want = {(a, b, int(apart[a, b])) for a, b in np.argwhere(apart < distance).tolist() if a < b}
    df = spark.createDataFrame([*enumerate(hashes.view(np.int64).tolist()), (999, None)], "k bigint, h bigint")
    monkeypatch.setattr(matching, "LEAST_BLOCK", 100)
    monkeypatch.setattr(matching, "SHARE", 7)
    monkeypatch.setattr(matching, "by_parts", None)  # no index for these
    got = near_hashes(df, "k", "h", distance).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(matching, "BROADCAST_PARTS", 1)
    assert {tuple(r) for r in near_hashes(df, "k", "h", distance).collect()} == want


def test_sign_hashes_within_twenty_bits(spark, tmp_path):
    """hash_near_pairs has the pairs of 16 to 19 bits, and those of rows that share a hash or an id."""
    from stillwright.catalog import QUERIES

    rng = np.random.default_rng(8)
    vectors = []
    for b in rng.choice([-1.0, 1.0], (20, 64)):
        for k in (0, 0, 5, 15, 16, 19, 20):
            v = b.copy()
            v[rng.choice(64, k, replace=False)] *= -1
            vectors.append(v)
    ids = list(range(len(vectors)))
    ids[9], ids[12] = ids[3], None
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    apart = [[int((u != v).sum()) for v in vectors] for u in vectors]
    both = [(i, j) for i in range(len(ids)) for j in range(len(ids)) if None not in (ids[i], ids[j]) and ids[i] < ids[j]]
    want = sorted((ids[i], ids[j], apart[i][j]) for i, j in both if apart[i][j] < 20)
    assert sorted(tuple(r) for r in QUERIES["hash_near_pairs"](spark, str(tmp_path)).collect()) == want
    assert {0, 15, 16, 19} <= {d for _, _, d in want}


def test_pairs_of_single_hashes_need_no_join(spark):
    """Blocks know the keys of hashes that one row has: near pairs are neither shuffled nor sent anywhere."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([*enumerate(rng.integers(-(2**63), 2**63, 500).tolist())], "k bigint, h bigint")
    found = near_hashes(df, "k", "h", 24)
    assert found.count() > 0 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_hash_are_dealt_to_tasks(spark):
    """All pairs of 5,000 rows of one hash come from several tasks."""
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit(77).cast("long").alias("h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = near_hashes(df, "k", "h", 1).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in found) == 5000 * 4999 // 2 and max(r["count"] for r in found) < 5000 * 4999 // 2


def test_a_fitted_text_is_split_once(spark):
    """Layout goes through the characters of a text once a size: it is not split again for each word, line and size."""
    from stillwright.functions import layout

    widths = F.create_map(*[F.lit(x) for kv in {"a": 0.53, "i": 0.27, " ": 0.29}.items() for x in kv])
    df = spark.createDataFrame([("a iii, aa",), ("",), (", a" * 9,), ("i" * 40,)], "t string").select(layout.fitted(F.col("t"), widths, F.lit(60.0), F.lit(70), 24).alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    got = [(r["f"]["size"], r["f"]["lines"], r["f"]["line_height"]) for r in df.collect()]
    assert got == [(24, ["a iii,", "aa"], 28), (24, [], 28), (20, [",", "a, a,", "a, a,", "a, a,", "a, a,", "a"], 24), (20, ["i" * 40], 24)]
