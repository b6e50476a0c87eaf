"""Golden cases of the operators, on literal tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwright.functions import text as t
from stillwright.functions import layout, timing, vectors
from stillwright.operators import buckets, frames, selection
from stillwright.operators.greedy import exclusive_matches, greedy_clusters, suppressed
from stillwright.operators.identities import identities, listed, representatives, with_ranks
from stillwright.operators.matching import band_join, best_centroid, by_prefix, near_hashes, nearest
from stillwright.operators.ranking import cast_size, global_rank, numbered_extras
from stillwright.sources import annotations as a
from stillwright.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cast_size_stops_at_the_first_drop(spark):
    rows = [(0, i, float(s)) for i, s in enumerate((83, 69, 13, 12))] + [(1, 0, 5.0)] + [(2, i, 10.0 - i) for i in range(6)]
    got = {r["g"]: r["cast_size"] for r in cast_size(spark.createDataFrame(rows, "g int, member int, score double"), "g", "score").collect()}
    assert got == {0: 2, 1: 2, 2: 4}


@pytest.mark.parametrize(
    "specs, pool, want",
    [
        ([(0, "F", 24)], [(0, 10, "F", 16), (1, 11, "F", 24)], [(0, 11, "matched")]),
        ([(0, "M", 24)], [(0, 10, "M", 22), (1, 11, "M", 24)], [(0, 10, "matched")]),
        ([(0, "M", 24), (1, "F", 30)], [(0, 10, "F", 31)], [(0, None, "missing"), (1, 10, "matched")]),
        ([(0, "M", 24), (1, "M", 24)], [(0, 10, "M", 24), (1, 11, "M", 80)], [(0, 10, "matched"), (1, 11, "fallback")]),
        ([(0, "M", 24)], [], [(0, None, "missing")]),
    ],
)
def test_roles_take_identities_without_replacement(spark, specs, pool, want):
    s = spark.createDataFrame([(w, *x) for w in (1, 2) for x in specs], "work int, pos int, sex string, age int")
    c = spark.createDataFrame([(1, *x) for x in pool], "work int, rank int, cid bigint, sex string, age int")
    got = exclusive_matches(s, c).orderBy("work", "pos").collect()
    assert [tuple(r)[1:] for r in got if r["work"] == 1] == want and {r["status"] for r in got if r["work"] == 2} == {"missing"}


def test_roles_match_like_a_plain_loop(spark):
    rnd = random.Random(6)
    specs = [(w, p, rnd.choice("MF"), rnd.randrange(15, 60)) for w in range(30) for p in range(rnd.randrange(1, 7))]
    pool = [(w, r, 100 * w + r, rnd.choice("MF"), rnd.randrange(15, 60)) for w in range(30) for r in range(rnd.randrange(14))]
    used = [(w, c) for w, _, c, _, _ in pool if rnd.random() < 0.15]
    want = []
    for w in range(30):
        taken = {c for x, c in used if x == w}
        for _, p, sex, age in [x for x in specs if x[0] == w]:
            free = sorted((r, c, a) for x, r, c, g, a in pool if x == w and g == sex and c not in taken)
            near = sorted((abs(a - age) // 5, r, c) for r, c, a in free if abs(a - age) <= 10)
            best = near[0][2] if near else free[0][1] if free else None
            taken.add(best)
            want.append((w, p, best, "matched" if near else "fallback" if free else "missing"))
    got = exclusive_matches(spark.createDataFrame(specs, "work int, pos int, sex string, age int"), spark.createDataFrame(pool, "work int, rank int, cid bigint, sex string, age int"), used=spark.createDataFrame(used, "work int, cid bigint"))
    assert sorted(map(tuple, got.collect())) == want and {x[3] for x in want} == {"matched", "fallback", "missing"}


def test_tile_choice_of_a_wide_image(spark):
    image = spark.createDataFrame([(1, 720, 1280)], "k int, h int, w int")
    pixels = [frames.tile_choice(image, "k", "h", "w", (c,)).first() for c in (128, 192, 256, 384)]
    assert [(r["tiles"], r["pixels"]) for r in pixels] == [(104, 1703936), (40, 1474560), (24, 1572864), (8, 1179648)]
    assert frames.tile_choice(image, "k", "h", "w").first()["tile"] == 384
    assert frames.tile_coords(image, "k", "h", "w", F.lit(384)).count() == 8


def test_separable_weights_are_the_plane_sums(spark):
    image = spark.createDataFrame([(1, 300, 260)], "k int, h int, w int")
    ys, xs = ({r["at"]: r["weight"] for r in frames.axis_weights(image, "k", n, F.lit(128)).collect()} for n in ("h", "w"))
    tiles = [(r["y"], r["x"]) for r in frames.tile_coords(image, "k", "h", "w", F.lit(128)).collect()]
    ramp = np.minimum(1, np.minimum(np.arange(1, 129), np.arange(128, 0, -1)) / 33)
    plane = np.zeros((max(ys) + 1, max(xs) + 1))
    for y, x in tiles:
        plane[y : y + 128, x : x + 128] += np.outer(ramp, ramp)
    assert np.allclose(plane, np.outer([ys[i] for i in sorted(ys)], [xs[i] for i in sorted(xs)]))


@pytest.mark.parametrize("name", ["Lâm Tri Hạ", "Lam Tri Ha", "LamTriHa", "Lâm Tri Hạ"])
def test_names_fold_alike(spark, name):
    assert one(spark, t.folded_name(F.lit(name))) == "LamTriHa"
    assert one(spark, t.folded_name(F.lit("đường 9"))) == "Duong9"


def test_subtitles(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hello</i>\r\nHello\r\n\r\n2\r\n0:03.5 --> 0:04.0\r\nHello\r\n50000\r\n{x}bye\r\n\r\n7\r\nHello\r\nbye\r\n"
    rows = a.dialogue(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("pos").collect()
    assert [r["line"] for r in rows] == ["Hello", "50000", "bye", "7", "Hello", "bye"]


def test_moment_files(spark):
    text = "# note\n1:02:03 first scene\n1:44:35:20 x\n104:42 x\n123:01:02 late\n04:05 second\n#CAST: nam 30 A\nCAST: bad\nCAST: nu\u031b\u0303~26 B, oops, # 2 C, @ 1:00 D, nam30 E,@2:00 \nCAST: nam 40 Z\nSIM: .45 abc\nSIM: .5\nSIM: .6\nTHE LOAI: HD\nTHELOAI: tt\nTHE_LOAI: toolong\nTHEM: vat 2:10 key\nthem: CHUNG 0:03:00 all\nPHU: 3, nu 9\nstray\n"
    rows = a.moment_lines(spark.createDataFrame([("d", text)], "doc string, text string")).cache()
    found = a.moments(rows)
    assert [(r["sec"], r["label"]) for r in found.orderBy("line_no").collect()] == [(3723, "first scene"), (442862, "late"), (245, "second")]
    assert [(r["label"], r["part"]) for r in a.story(found, 1).orderBy("line_no").collect()] == [("first scene", "scene"), ("late", "beat")]
    assert [r["line"] for r in a.rejects(rows).orderBy("line_no").collect()] == ["1:44:35:20 x", "104:42 x", "SIM: .45 abc", "THE_LOAI: toolong", "stray"]
    specs, bad = a.role_specs(rows)
    assert [(r["pos"], r["kind"], r["sex"], r["n"], r["label"]) for r in specs.orderBy("pos").collect()] == [(0, "desc", "F", 26, "B"), (2, "pin", None, 2, "C"), (3, "time", None, 60, "D"), (4, "desc", "M", 30, "E")]
    assert [r["entry"] for r in bad.orderBy("line_no").collect()] == ["bad", "oops", "@2:00"]
    specs, bad = a.role_specs(rows, a.EXTRA_CAST, ids=False)
    assert [(r["pos"], r["kind"], r["n"]) for r in specs.collect()] == [(1, "desc", 9)] and bad.first()["entry"] == "3"
    assert a.first_value(rows, a.SIMILARITY).first()["value"] == ".5" and a.first_value(rows, a.GENRE).first()["value"] == "hd"
    assert [(r["kind"], r["sec"], r["label"]) for r in a.extras(rows).orderBy("pos").collect()] == [("vat", 130, "key"), ("chung", 180, "all")]
    ids, _ = a.role_specs(a.moment_lines(spark.createDataFrame([("d", "CAST: 3, 1,3")], "doc string, text string")))
    assert [(r["kind"], r["n"]) for r in ids.orderBy("pos").collect()] == [("id", 3), ("id", 1)]


def test_scans_of_names_titles_and_listings(spark, tmp_path):
    for film, text in (("a", "\ufeffFirst\n# note\n\n  Second "), ("b", "Other"), ("c", "Mine")):
        (tmp_path / film).mkdir()
        (tmp_path / film / "title.txt").write_text(text, encoding="utf-8")
    got = a.approved(spark, str(tmp_path), "c").orderBy("film", "pos").collect()
    assert [(r["film"], r["line"]) for r in got] == [("a", "First"), ("a", "Second"), ("b", "Other")]
    files = spark.createDataFrame([("in/10.jpg", "10", ".jpg"), ("in/9.jpg", "9", ".jpg"), ("in/x.PNG", "x", ".png"), ("in/xong/1.jpg", "1", ".jpg"), ("in/a.srt", "a", ".srt")], "path string, stem string, suffix string")
    assert [r["frame_no"] for r in a.keyframes(a.images(files), F.lit(25.0)).orderBy("frame_no").collect()] == [9, 10]
    assert {r["stem"] for r in a.images(files).collect()} == {"10", "9", "x"}
    assert a.named_only(files, ["x"]).count() == 1 and a.named_only(files, []).count() == 5
    assert [(r["stem"], r["scan"]) for r in a.in_sequence(files.where("suffix = '.srt'"), files.where("stem = 'x'")).orderBy("scan").collect()] == [("a", 0), ("x", 1)]
    listing = spark.createDataFrame([("a.mp4",), ("b.VTT",), ("c.flv",), ("d.srt",)], "name string")
    present = spark.createDataFrame([("a.mp4", 0), ("d.srt", 5)], "name string, bytes bigint")
    assert {r["name"] for r in a.to_fetch(listing, present).collect()} == {"a.mp4", "b.VTT"}
    names = spark.createDataFrame([("x.flv",), ("x.ts",)], "n string").select(a.is_video(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in names] == [True, False]


def test_titles_and_lists(spark):
    shape = lambda x: one(spark, t.title_faults(F.lit(x)))
    first = "Chàng Thợ Nghèo Bị Xóm Làng Khinh Rẻ"
    good = f"{first}, Ai Ngờ Thuyền Cũ Giấu Báu Vật Nghìn Năm Khiến Tất Cả Sững Sờ"
    assert len(good) in range(91, 101) and 21 <= len(good.split()) <= 25 and 30 <= len(first) <= 45 and shape(good) == []
    assert shape(good.replace("Ai Ngờ", "Nào Hay")) == ["turn"] and shape("Và Cái Kết") == ["length", "words", "commas", "clause", "turn", "consequence", "banned"]
    noise = ["[Tối ưu số 1]", "## head", "```", "chọn: 3", "VÌ SAO : x", "Á QUÂN: y"]
    assert all(one(spark, t.is_noise(F.lit(x))) for x in noise) and not one(spark, t.is_noise(F.lit("[a] title")))
    assert [one(spark, t.clean_title(F.lit(x))) for x in ("1. a (97)", "👉 b [ 12 ]", "- c", "2) d", "12 e")] == ["a", "b", "c", "d", "12 e"]
    line = lambda x: one(spark, t.listed_image(F.lit(x)))
    assert line("chinh_2_Lan_1m02.jpg") == "- `chinh_2_Lan_1m02.jpg` — NHÂN VẬT CHÍNH 2, tên trong phim: Lan"
    assert line("x/phu_1__9m.jpg") == "- `phu_1__9m.jpg` — nhân vật phụ 1" and line("chinh_1.jpg") is None and line("other.jpg") is None
    assert one(spark, t.is_folder_link(F.lit("https://x/drive/folders/1"))) and not one(spark, t.is_folder_link(F.lit("https://x/file/d/1")))
    assert one(spark, t.first_available(["a", "b", "c"], F.array(F.lit("c"), F.lit("b")))) == "b" and one(spark, t.first_available(["a"], F.array(F.lit("c")))) is None


def test_pairing_and_queue(spark):
    videos = spark.createDataFrame([("a",), ("b",)], "stem string")
    subs = spark.createDataFrame([("a", ".txt", "a.txt"), ("a", ".srt", "a.srt"), ("c", ".srt", "c.srt"), ("b.moments", ".txt", "b.moments.txt")], "stem string, suffix string, path string")
    assert {r["stem"]: r["subtitle"] for r in a.paired(videos, subs).collect()} == {"a": "a.srt", "b": None}
    assert a.paired(videos.limit(0).unionByName(spark.createDataFrame([("z",)], "stem string")), subs.where("stem = 'c'")).first()["subtitle"] == "c.srt"


def test_inventory_and_whole_texts(spark, tmp_path):
    (tmp_path / "x.MP4").write_bytes(b"12345")
    (tmp_path / "x.srt").write_text("﻿hi", encoding="utf-8")
    got = {(r["stem"], r["suffix"], r["bytes"]) for r in a.inventory(spark, str(tmp_path)).collect()}
    assert got == {("x", ".mp4", 5), ("x", ".srt", 5)}
    assert a.whole_texts(spark, str(tmp_path / "x.srt")).first()["text"] == "hi"
    (tmp_path / "s.tsv").write_text("# c\n5\tch\tabc\ttitle one\n")
    assert tuple(a.sample(spark, str(tmp_path / "s.tsv")).first()) == (5, "ch", "abc", "title one")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "video string, n int")
    sinks.write_cache(df, str(tmp_path / "c"), "video")
    sinks.write_cache(df.where("video = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "c"), "video")
    assert {(r["video"], r["n"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {("a", 9), ("b", 2)}
    row = sinks.manifest(spark.createDataFrame([("nam", 1, "Lâm Hạ", 75)], "role string, number int, label string, sec int"), F.col("role"), F.col("number"), F.col("label"), F.col("sec")).first()
    assert row["dest"] == "nam_1_LamHa_1m15.jpg"
    seen = spark.createDataFrame([("a", 5), ("b", 5)], "stem string, bytes bigint")
    now = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "stem string, bytes bigint")
    assert {r["stem"] for r in sinks.changed_sources(now, seen).collect()} == {"b", "c"}
    sinks.write_texts(spark.createDataFrame([("a", "one\ntwo"), ("b", "x")], "doc string, body string"), str(tmp_path / "t"), "doc", "body")
    assert {(r["doc"], r["value"]) for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()} == {("a", "one\ntwo\n"), ("b", "x\n")}


def test_scans_are_recorded_after_they_succeed(spark, tmp_path):
    files = spark.createDataFrame([("a", "p/a", 5), ("b", "p/b", 7)], "stem string, path string, bytes bigint")
    cache, records = str(tmp_path / "cache"), str(tmp_path / "records")

    def fails(todo):
        return todo.select("stem", F.raise_error(F.lit("no")).cast("int").alias("n"))

    with pytest.raises(Exception):
        sinks.scan_changed(files, fails, cache, records)
    assert sinks.read_cache(spark, records, "bytes bigint, stem string").count() == 0
    scan = lambda todo: todo.select("stem", (F.col("bytes") * 2).alias("n"))
    assert sinks.scan_changed(files, scan, cache, records).count() == 2
    assert sinks.scan_changed(files, fails, cache, records).count() == 0
    later = files.withColumn("bytes", F.when(F.col("stem") == "b", 9).otherwise(F.col("bytes")))
    assert [r["stem"] for r in sinks.scan_changed(later, scan, cache, records).collect()] == ["b"]
    assert {(r["stem"], r["n"]) for r in sinks.read_cache(spark, cache, "n bigint, stem string").collect()} == {("a", 10), ("b", 18)}


@pytest.mark.parametrize("sec, want", [(0, "00:00"), (59, "00:59"), (3599, "59:59"), (3600, "1:00:00"), (36061, "10:01:01")])
def test_clock(spark, sec, want):
    assert one(spark, timing.hms(F.lit(sec))) == want
    assert one(spark, timing.clock_seconds(F.lit(want))) == sec


def test_small_functions(spark):
    assert one(spark, timing.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    assert [one(spark, timing.frame_rate(F.lit(x))) for x in ("25", "0/0", "x", None)] == [25.0, 30.0, 30.0, 30.0]
    assert [one(spark, timing.backoff(F.lit(k))) for k in (1, 2, 4, 9)] == [5.0, 10.0, 40.0, 60.0]
    assert one(spark, t.shared_id(F.lit("https://x/file/d/Ab-1_/view"))) == "Ab-1_" and one(spark, t.shared_id(F.lit("https://x/open?id=Q9"))) == "Q9"
    assert one(spark, t.without_suffix(F.lit("a.srt - Drive"), " - Drive")) == "a.srt"
    assert one(spark, t.page_title(F.lit("<TITLE>\n a &amp; &lt;b&gt; </title>"))) == "a & <b>"
    assert one(spark, t.clean_title(F.lit(" 12. Some title (97)"))) == "Some title"
    assert [one(spark, t.length_class(F.lit("x" * n))) for n in (60, 61, 70, 71, 100, 101)] == ["ok", "long", "long", "cut", "cut", "too_long"]
    assert one(spark, t.preview(F.lit("y" * 51))) == "y" * 50 + "..." and one(spark, t.preview(F.lit("y" * 50))) == "y" * 50
    assert one(spark, t.filled(F.lit("{A}-{B}"), [("{A}", F.lit("{B}")), ("{B}", F.lit("z"))])) == "z-z"
    assert tuple(one(spark, t.role_file_name(F.lit("out/nam_2_Lan_Anh.jpg")))) == ("nam", 2, "Lan_Anh") and one(spark, t.role_file_name(F.lit("x.jpg")))["role"] is None
    assert one(spark, vectors.lip_gap(F.lit(None).cast("array<array<double>>"), F.lit(1.0))) == 1.0
    assert one(spark, vectors.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64
    grid = F.array(*[F.array(*[F.lit(float(x)) for x in range(9)]) for _ in range(8)])
    assert one(spark, vectors.difference_hash(grid)) == -1


FACE = dict(w=0.12, det=0.60, sharp=100.0, yaw=25.0, roll=20.0, pitch=22.0, lip_gap=0.15, inside=True)


def test_bounds_are_inclusive_and_gates_lose_nothing(spark):
    rows = [FACE, *({**FACE, k: v} for k, v in dict(w=0.119, det=0.59, sharp=99.9, yaw=25.1, roll=20.1, pitch=22.1, lip_gap=0.149, inside=False).items()), {**FACE, "w": 0.06, "det": 0.45, "sharp": 40.0, "yaw": 70.0}, {**FACE, "sharp": 39.9}, {**FACE, "yaw": 70.1}]
    df = buckets.bucketed(spark.createDataFrame([{**r, "id": i} for i, r in enumerate(rows)]))
    got = {r["id"]: (r["bucket"], r["reason"]) for r in df.collect()}
    assert got[0] == ("strict", None) and {got[i][0] for i in range(1, 10)} == {"loose"}
    assert got[4][1] == got[6][1] == "turned" and got[7][1] == "teeth" and got[5][1] is None
    assert got[10] == ("rejected", "blurred") and got[11] == ("rejected", None)
    kept = buckets.bucketed(buckets.gated(df.drop("bucket", "reason"))).where("bucket <> 'rejected'")
    assert {r["id"] for r in kept.collect()} == {i for i, (b, _) in got.items() if b != "rejected"}


def test_greedy_folds_match_plain_loops(spark):
    rng = np.random.default_rng(3)
    vectors_ = rng.normal(size=(120, 8))
    vectors_ /= np.linalg.norm(vectors_, axis=1)[:, None]
    sums, want = [], []
    for v in vectors_:
        sims = [s @ v / np.linalg.norm(s) for s in sums]
        k = int(np.argmax(sims)) if sims and max(sims) >= 0.5 else len(sums)
        sums[k:] = [*([sums[k] + v] if k < len(sums) else [v]), *sums[k + 1 :]]
        want.append(k)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vectors_)], "g bigint, i bigint, v array<double>").repartition(3)
    assert [r["cid"] for r in greedy_clusters(df, "g", "i", "v", 0.5).orderBy("i").collect()] == want


def test_suppression_is_maximal_and_compatible(spark):
    rnd = random.Random(5)
    rows = [(g, i, rnd.random(), rnd.randrange(500), rnd.getrandbits(62)) for g in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, s double, sec bigint, h bigint").repartition(4)
    got = {}
    for r in suppressed(df, "g", "i", "s", "sec", 20, "h", 25).collect():
        got.setdefault(r["g"], set()).add(r["i"])
    near = lambda a, b: abs(a[3] - b[3]) < 20 or (a[4] ^ b[4]).bit_count() < 25
    for g in range(3):
        mine = [r for r in rows if r[0] == g]
        chosen = [r for r in mine if r[1] in got[g]]
        assert not any(near(x, y) for x in chosen for y in chosen if x is not y)
        assert all(r in chosen or any(near(r, x) and x[2] >= r[2] for x in chosen) for r in mine)


def test_nearest_pin_beyond_the_band(spark):
    items = spark.createDataFrame([(1, 100), (2, 104), (3, 5000), (4, 5000)], "i bigint, s bigint")
    pins = spark.createDataFrame([(0, 102), (1, 90000), (2, -9000), (3, 4990), (4, 2552)], "p bigint, at bigint")
    got = {r["p"]: (r["i"], r["distance"]) for r in nearest(pins, items, "p", "at", "i", "s", 50).collect()}
    assert got == {0: (1, 2), 1: (3, 85000), 2: (1, 9100), 3: (3, 10), 4: (2, 2448)}
    assert band_join(items, pins, "s", "at", 50).count() == 4


def test_centroids_in_blocks_equal_one_block(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "i bigint, v array<double>")
    cents = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(17)], "cid bigint, centroid array<double>")
    whole, blocks = (sorted(map(tuple, best_centroid(items, cents, "i", "v", 1.5, most, 13).collect()), key=lambda r: r[0]) for most in (10_000, 100))
    assert whole == blocks and len(whole) == 60 and None in {c for _, c, _ in whole}
    assert all(c is None for _, c, _ in best_centroid(items, cents.limit(0), "i", "v", 0.5).collect())


def test_near_hashes_are_all_pairs(spark):
    rnd = random.Random(4)
    codes = [rnd.getrandbits(64) for _ in range(40)]
    codes += [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 20))) for c in codes]
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    want = {(i, j, (codes[i] ^ codes[j]).bit_count()) for i in range(80) for j in range(i + 1, 80) if (codes[i] ^ codes[j]).bit_count() < 12}
    got = near_hashes(spark.createDataFrame(list(enumerate(signed)), "k bigint, h bigint"), "k", "h", 12).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_identities_without_ages_or_sexes(spark):
    rows = [(1, 0, 0.5, 90, None, None, 1), (1, 0, 0.5, 30, None, 0, 2), (1, 1, 0.7, 10, "M", 23, 3), (1, 1, 0.7, 20, "F", 24, 4), (1, 1, 0.6, 7300, "M", 0, 5)]
    members = spark.createDataFrame(rows, "v int, c int, w double, s int, sex string, age int, face int")
    got = {r["c"]: r for r in identities(members, "v", "c", "w", "s", "sex", "age").collect()}
    assert [(got[k]["sex"], got[k]["age"], got[k]["n"], got[k]["rank"]) for k in (0, 1)] == [("?", 0, 2, 1), ("M", 23, 3, 0)]
    table = listed(identities(members, "v", "c", "w", "s", "sex", "age"), "v", least=3)
    assert [(r["c"], r["first_min"], r["last_min"]) for r in table.collect()] == [(1, 0, 121)]
    faces = members.select("v", "c", "face", F.lit(1.0).alias("det"), "w", F.lit(100.0).alias("sharp"))
    assert {r["c"]: r["face"] for r in representatives(faces, ["v", "c"], "face", "face").collect()} == {0: 1, 1: 3}


def _fits(hashes, code):
    return all((h ^ code).bit_count() >= 12 for h in hashes)


def _plain_stills(frames, at, cast_size, n_roles):
    """Stills of one work by loops over frames: frame, sec, hash, faces (rank, strict, det, w, sharp, yaw, mouth, emb)."""
    crisp, straight = (lambda f: min(f["sharp"] / 250, 1)), (lambda f: max(0.0, 1 - f["yaw"] / 25))
    known = lambda f: 99 if f["rank"] is None else f["rank"]
    rows = []
    for fr in frames:
        strict = [f for f in fr["faces"] if f["strict"]]
        if not strict:
            continue
        roles = {known(f) for f in fr["faces"] if known(f) < n_roles}
        n_main = sum(r < cast_size for r in roles)
        best = max(f["det"] * (0.5 + f["w"]) * (0.4 + crisp(f)) * (1.6 if known(f) < n_roles else 1) for f in strict)
        per = {}
        for f in strict:
            if known(f) < cast_size:
                per[known(f)] = max(per.get(known(f), 0), f["det"] * min(f["w"] / 0.25, 1) * (0.4 + crisp(f)) * (0.6 + 0.4 * straight(f)))
        rows.append({**fr, "strict": strict, "roles": roles, "n_main": n_main, "n": sum(f["strict"] or f["rank"] is not None for f in fr["faces"]), "score": best * (1 + max(0, n_main - 1)), "group": min(per.values()) if per and len(per) == cast_size else 0})
    if not rows:
        return []
    rows.sort(key=lambda r: (-r["score"], r["frame"]))
    full = sorted((r for r in rows if r["group"] > 0), key=lambda r: -r["group"])
    near = [r for r in full if at is not None and abs(r["sec"] - at) <= 120]
    groups = (near or full)[:2] if full else [r for r in rows if r["n_main"] == max(x["n_main"] for x in rows)][:1]
    kept, hashes = [], []
    for r in groups:
        if _fits(hashes, r["hash"]):
            kept.append(("group", len(kept) + 1, r["frame"]))
            hashes.append(r["hash"])
    anchor = {}
    for f in sorted(groups[0]["faces"], key=lambda f: f["pos"]):
        if known(f) < cast_size and (known(f) not in anchor or f["w"] > anchor[known(f)]["w"]):
            anchor[known(f)] = f
    for who in range(n_roles):
        found = []
        for r in rows:
            mine = [f for f in r["strict"] if known(f) == who]
            if r is groups[0] or not mine:
                continue
            q = max(f["det"] * (0.5 + f["w"]) * (0.4 + crisp(f)) * (0.6 + straight(f)) * (0.55 + 0.45 * max(0.0, 1 - max(0.0, f["mouth"] - 0.4) / 0.4)) for f in mine)
            q *= 1.35 if r["n"] == 1 else 1
            if who in anchor:
                q *= 0.4 + max(0.0, max(float(np.dot(f["emb"], anchor[who]["emb"])) for f in mine))
            found.append((q, r))
        for _, r in sorted(found, key=lambda x: -x[0]):
            if _fits(hashes, r["hash"]):
                kept.append(("solo", who + 1, r["frame"]))
                hashes.append(r["hash"])
                break
    return kept


def test_stills_equal_plain_loops(spark):
    rnd = random.Random(17)
    works, faces, frames, moments = {}, [], [], []
    for video in range(25):
        base = [rnd.getrandbits(62) for _ in range(4)]
        works[video] = []
        for k in range(rnd.randrange(1, 15)):
            code = rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(62), rnd.choice([3, 9, 25])))
            held = [dict(rank=rnd.choice([None, 0, 1, 2, 3]), strict=rnd.random() < 0.7, det=rnd.random(), w=rnd.random() / 2, sharp=rnd.random() * 400, yaw=rnd.random() * 30, mouth=rnd.random(), emb=np.array([rnd.uniform(-1, 1) for _ in range(4)]).tolist(), pos=i) for i in range(rnd.randrange(1, 5))]
            works[video].append(dict(frame=100 * video + k, sec=k * 40, hash=code, faces=held))
            frames.append((video, 100 * video + k, k * 40, code))
            faces += [(video, 100 * video + k, *f.values()) for f in held]
        if video % 3:
            moments.append((video, rnd.randrange(500)))
    face = spark.createDataFrame(faces, "video bigint, frame bigint, rank int, strict boolean, det double, w double, sharp double, yaw double, mouth double, emb array<double>, pos int").repartition(3)
    frame = spark.createDataFrame(frames, "video bigint, frame bigint, sec int, hash bigint")
    at = spark.createDataFrame(moments, "video bigint, at int")
    scored = selection.scored_frames(face, ["video", "frame"], 2, 3).join(frame, ["video", "frame"])
    got = selection.stills(face, scored, at, "video", "frame", 2, 3).collect()
    want = {(v, *x) for v, fs in works.items() for x in _plain_stills(fs, dict(moments).get(v), 2, 3)}
    assert {(r["video"], r["role"], r["idx"], r["frame"]) for r in got} == want and len(got) == len(want)
    assert {x[1] for x in want} == {"group", "solo"}


def _plain_moments(frames, moments, n, gap, around):
    frames = sorted(frames, key=lambda f: (-f["score"], f["frame"]))
    picked = []
    apart = lambda f, g: all(abs(f["sec"] - p["sec"]) >= g for p, _ in picked) and _fits([p["hash"] for p, _ in picked], f["hash"])
    for number, at in moments[:n]:
        near = [f for f in frames if abs(f["sec"] - at) <= around]
        duo = [f for f in near if f["duo"]]
        if duo and duo[0]["score"] >= 0.75 * near[0]["score"]:
            near = duo + [f for f in near if not f["duo"]]
        for f in near:
            if len(picked) < n and apart(f, min(gap, 20)):
                picked.append((f, number))
                break
    for f in frames:
        if len(picked) < n and apart(f, gap):
            picked.append((f, None))
    return {(f["frame"], number) for f, number in picked}


def test_group_stills_give_way_to_those_chosen_by_hand(spark):
    stills = spark.createDataFrame([("a", "group", 1), ("a", "solo", 1), ("b", "group", 1)], "doc string, role string, idx int")
    extras = spark.createDataFrame([("a", "chung"), ("b", "vat")], "doc string, kind string")
    assert {(r["doc"], r["role"]) for r in selection.without_replaced(stills, extras, "doc").collect()} == {("a", "solo"), ("b", "group")}
    faces = spark.createDataFrame([(1, 0), (1, 5), (1, None)], "v int, cid int")
    ranks = with_ranks(faces, spark.createDataFrame([(1, 0, 3)], "v int, cid int, rank int"), "v")
    assert {(r["cid"], r["rank"]) for r in ranks.collect()} == {(0, 3), (5, None), (None, None)} and {one(spark, selection.known_rank(F.lit(x).cast("int"))) for x in (3, None)} == {3, 99}


def test_moment_stills_equal_plain_loops(spark):
    rnd = random.Random(3)
    frames = {v: [dict(frame=100 * v + k, sec=rnd.randrange(2000), score=round(rnd.random(), 3), duo=rnd.random() < 0.3, hash=rnd.getrandbits(60) if rnd.random() < 0.8 else 5) for k in range(rnd.randrange(1, 40))] for v in range(20)}
    moments = {v: [(m, rnd.randrange(2000)) for m in range(rnd.randrange(0, 8))] for v in range(20)}
    df = spark.createDataFrame([(v, *f.values()) for v, fs in frames.items() for f in fs], "v bigint, frame bigint, sec int, score double, duo boolean, hash bigint")
    ms = spark.createDataFrame([(v, *m) for v, x in moments.items() for m in x], "v bigint, moment bigint, at int")
    got = selection.moment_stills(df, ms, "v", "frame", 5, 45).collect()
    want = {(v, *x) for v in frames for x in _plain_moments(frames[v], moments[v], 5, 45, 120)}
    assert {(r["v"], r["frame"], r["moment"]) for r in got} == want and len(got) == len(want)


def test_prefix_precedence(spark):
    prefixes = spark.createDataFrame([("ab", "two"), ("abc", "three")], "prefix string, value string")
    items = spark.createDataFrame([("ABcd", None), ("abx", None), ("zz", None), ("abc", "ab"), ("abc", "nope")], "n string, o string")
    got = {(r["n"], r["o"]): r["value"] for r in by_prefix(items, prefixes, "n", F.col("o"), "none").collect()}
    assert got == {("ABcd", None): "three", ("abx", None): "two", ("zz", None): "none", ("abc", "ab"): "two", ("abc", "nope"): "three"}


@pytest.mark.parametrize("parts", [1, 7])
def test_global_rank_does_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select(((F.col("id") * 37) % 11).alias("s"), "id").repartition(parts)
    got = [r["id"] for r in global_rank(df, [F.desc("s"), F.col("id")]).orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (-(i * 37 % 11), i))


def test_group_scores(spark):
    faces = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 1, 0.7), (2, 0, 0.8)], "f int, role int, q double")
    assert {r["f"]: r["group_score"] for r in frames.weakest_role(faces, ["f"], "role", "q", 2).collect()} == {1: 0.5, 2: 0.0}
    assert {r["group_score"] for r in frames.weakest_role(faces, ["f"], "role", "q", 0).collect()} == {0.0}
    assert one(spark, frames.solo_score(F.lit(1.0), F.lit(True), F.lit(0.6))) == pytest.approx(1.35)
    cells = spark.createDataFrame([(0, 2.0, 1.0), (0, 3.0, 1.0), (1, 900.0, 1.0)], "at int, v double, w double")
    assert {r["at"]: r["v"] for r in frames.blended(cells, ["at"], "v", "w").collect()} == {0: 2, 1: 255}


def test_streams(spark, tmp_path):
    from stillwright.streaming.ingest import appended, arriving_files, windowed_tally

    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name in ("a.mp4", "b.srt"):
        (tmp_path / "in" / name).write_text("x")
        appended(arriving_files(spark, str(tmp_path / "in")), out, check).awaitTermination()
    assert {(r["stem"], r["suffix"]) for r in spark.read.parquet(out).collect()} == {("a", ".mp4"), ("b", ".srt")} and spark.read.parquet(out).count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "u"), ("2024-01-01 00:50:00", "u")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    assert windowed_tally(events, "ts", "k").first()["n"] == 2


def _wrap(text, width, most):
    lines, cur = [], ""
    for w in text.split():
        longer = f"{cur} {w}".strip()
        if width(longer) <= most or not cur:
            cur = longer
        else:
            lines.append(cur)
            cur = w
        if not lines and cur.endswith(","):
            lines, cur = [cur], ""
    return [*lines, *([cur] if cur else [])]


@pytest.mark.parametrize("text", ["", "one", "a few words, and then some more, which go on", "averyverylongwordindeed, x", "no comma at all in these words here"])
def test_titles_wrap_and_fit(spark, text):
    widths = F.create_map(F.lit("a"), F.lit(0.5), F.lit(" "), F.lit(0.25))
    width = lambda s, size: size * sum({"a": 0.5, " ": 0.25}.get(c, 0.6) for c in s)
    assert one(spark, layout.wrapped(F.lit(text), widths, F.lit(20), F.lit(150))) == _wrap(text, lambda s: width(s, 20), 150)
    got = one(spark, layout.fitted(F.lit(text), widths, F.lit(300.0), F.lit(120.0), 60))
    for size in range(60, 18, -2):
        lines = _wrap(text, lambda s: width(s, size), 300)
        if len(lines) * int(size * 1.18) <= 120 and all(width(x, size) <= 300 for x in lines):
            assert tuple(got) == (size, lines, int(size * 1.18))
            break
    else:
        assert (got["size"], got["line_height"]) == (20, 24)


def test_pixel_arithmetic(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (9, 11)).astype(float)
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    rows = spark.createDataFrame([(g.tolist(),), (g[:7].tolist(),), (None,)], "r array<array<double>>")
    got = [r["x"] for r in rows.select(layout.sharpness(F.col("r")).alias("x")).collect()]
    assert got[0] == pytest.approx(lap.var()) and got[1:] == [0.0, 0.0]
    wide = one(spark, layout.resized(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in g.tolist()]), 16))

    def cell(y, x, size=16):
        at = lambda i, n: min(max((i + 0.5) * n / size - 0.5, 0), n - 1)
        v, u = at(y, 9), at(x, 11)
        i, j = min(int(v), 7), min(int(u), 9)
        return sum(g[i + a, j + b] * (v - i if a else 1 - v + i) * (u - j if b else 1 - u + j) for a in (0, 1) for b in (0, 1))

    assert all(abs(wide[y][x] - cell(y, x)) <= 0.5 + 1e-9 for y in range(16) for x in range(16)) and len(wide) == len(wide[0]) == 16
    assert one(spark, layout.sharpness(F.array(*[F.array(*[F.lit(7.0)] * 9)] * 9), 128)) == 0.0
    assert [one(spark, layout.on_white(F.lit(v), F.lit(a))) for v, a in ((10, 255), (10, 0), (0, 127))] == [10, 255, 128]
    size = lambda *x: one(spark, layout.target_size(*[F.lit(v) for v in x]))
    assert tuple(size(720, 1280, 640, 4.0)) == (360, 640) and tuple(size(5, 5, 0, 0.5)) == (2, 2) and size(720, 1280, 0, 4.0) is None and size(720, 1280, 5120, 4.0) is None


def test_extras_continue_the_group_numbers(spark):
    extras = spark.createDataFrame([("d", 1, "vat"), ("d", 2, "chung"), ("d", 5, "vat"), ("e", 1, "chung")], "doc string, pos int, kind string")
    chosen = spark.createDataFrame([("d", "chung"), ("d", "chung"), ("d", "nam")], "doc string, role string")
    assert {(r["doc"], r["pos"]): r["number"] for r in numbered_extras(extras, chosen).collect()} == {("d", 1): 1, ("d", 2): 3, ("d", 5): 2, ("e", 1): 1}
