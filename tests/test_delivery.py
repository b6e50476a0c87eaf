"""Deliveries into folders with files of their owner, and streams that begin anew with a changed file."""

import os

import pytest
from pyspark.sql import functions as F

from stillwright.sources import delivery
from stillwright.streaming.tallies import running_tallies


def tree(folder):
    return {f"{d}/{x}".removeprefix(f"{folder}/"): open(f"{d}/{x}", "rb").read() for d, _, names in os.walk(folder) for x in names if not x.endswith(".crc")}


@pytest.fixture
def works(tmp_path):
    (tmp_path / "frames").mkdir()
    for i in range(12):
        (tmp_path / "frames" / f"{i}.jpg").write_bytes(bytes([i]) * (5 if i < 6 else 3_000_000))
    for w in ("a", "b"):
        (tmp_path / "out" / w).mkdir(parents=True)
    own = {"a/title.txt": b"mine", "a/thumb.png": b"paid", "a/holiday.jpg": b"own", "b/chinh.txt": b"own"}
    old = {"a/chinh_1_X_0m01.jpg": b"old", "a/rieng_01.jpg": b"older", "b/vat_1_k_2m00.jpg": b"old", "a/.chinh_9_Y_0m02.jpg.12ab.part": b"half"}
    for name, data in (own | old).items():
        (tmp_path / "out" / name).write_bytes(data)
    return tmp_path, own


def plan(spark, root, rows):
    return spark.createDataFrame([(f"{root}/out/{w}", dest, f"{root}/frames/{i}.jpg") for w, dest, i in rows], "folder string, dest string, src string")


ROWS = [("a", "chinh_1_X_0m01.jpg", 1), ("a", "canh_chung_1_0m03.jpg", 7), ("b", "phu_1_Z_0m09.jpg", 2), ("c", "chinh_1_Q_1m00.jpg", 8), ("c", "chinh_2_Q_1m00.jpg", 8)]


def test_a_delivery_keeps_the_owners_files_and_changes_nothing_twice(spark, works):
    root, own = works
    frame = lambda i: (root / "frames" / f"{i}.jpg").read_bytes()
    want = own | {f"{w}/{dest}": frame(i) for w, dest, i in ROWS}
    got = {(os.path.basename(r["folder"]), r["dest"]): r["status"] for r in delivery.deliver(plan(spark, root, ROWS)).collect()}
    assert tree(root / "out") == want
    assert sorted(v for v in got.values()) == ["copied"] * 5 + ["deleted"] * 3 and got["a", "rieng_01.jpg"] == "deleted"
    before = {x: os.stat(root / "out" / x).st_mtime_ns for x in want}
    again = delivery.deliver(plan(spark, root, ROWS + ROWS[:2])).collect()
    assert {r["status"] for r in again} == {"kept"} and {x: os.stat(root / "out" / x).st_mtime_ns for x in want} == before
    # a frame of the same size and other bytes is copied, a planned one without a source is reported
    got = {r["dest"]: r["status"] for r in delivery.deliver(plan(spark, root, [("a", "chinh_1_X_0m01.jpg", 3), ("a", "phu_2_N_0m00.jpg", 99)])).collect()}
    assert got == {"chinh_1_X_0m01.jpg": "copied", "phu_2_N_0m00.jpg": "missing", "canh_chung_1_0m03.jpg": "deleted"}
    assert tree(root / "out" / "a") == {x[2:]: v for x, v in own.items() if x[0] == "a"} | {"chinh_1_X_0m01.jpg": frame(3)}
    assert delivery.deliver(plan(spark, root, [])).count() == 0


def test_a_delivery_that_breaks_off_is_done_again(spark, works):
    root, own = works
    want = own | {f"{w}/{dest}": (root / "frames" / f"{i}.jpg").read_bytes() for w, dest, i in ROWS}
    os.symlink("nowhere", root / "out" / "d")  # a folder that can't be made: the delivery fails
    with pytest.raises(Exception, match="nowhere|d'|exist|cannot|Cannot|File"):
        delivery.deliver(plan(spark, root, [*ROWS, ("d", "chinh_1_R_0m00.jpg", 1)])).collect()
    assert (root / "out" / "a" / "rieng_01.jpg").exists() and (root / "out" / "a" / "title.txt").exists()  # nothing deleted yet
    os.unlink(root / "out" / "d")
    delivery.deliver(plan(spark, root, ROWS)).collect()
    assert tree(root / "out") == want


def test_changes_of_a_plan(spark):
    wanted = spark.createDataFrame([("f", "chinh_1.jpg", "s1", 5), ("f", "chinh_1.jpg", "s0", 9), ("f", "phu_1.jpg", "s2", 7), ("g", "vat_1.jpg", "s3", 1), (None, "x", "s", 1)], "folder string, dest string, src string, bytes bigint")
    there = spark.createDataFrame([("f", "chinh_1.jpg", 5), ("f", "phu_1.jpg", 8), ("f", "title.txt", 3), ("f", "chinh_2.jpg", 3), ("f", "chinh_2.png", 3), ("g", ".vat_2.jpg.0f.part", 0), ("h", "rieng_1.jpg", 2)], "folder string, name string, bytes bigint")
    got = sorted((r["folder"], r["dest"], r["src"] or "", r["status"]) for r in delivery.changes(wanted, there).collect())
    assert got == [("f", "chinh_1.jpg", "s1", "keep"), ("f", "chinh_2.jpg", "", "delete"), ("f", "phu_1.jpg", "s2", "copy"), ("g", ".vat_2.jpg.0f.part", "", "delete"), ("g", "vat_1.jpg", "s3", "copy"), ("h", "rieng_1.jpg", "", "delete")]


def test_a_changed_file_begins_anew(spark, tmp_path):
    """Three triggers on one checkpoint, against a plain fold of all rows."""
    batches = [
        [("a", "100", 1, 1.0), ("a", "100", 1, 2.0), ("b", "7", 1, 5.0), (None, "1", 1, 1.0)],
        [("a", "100", 2, 4.0), ("b", "9", 2, 1.0), ("b", "9", 2, None), ("c", "1", 2, 3.0)],
        [("a", "200", 3, 10.0), ("a", "100", 1, 50.0), ("b", "9", 1, 2.0), ("c", None, 3, 1.0), ("b", "9", 3, 6.0)],
    ]
    schema, seen, held = "stem string, version string, scan bigint, value double", {}, {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = running_tallies(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))

        def put(df, _):
            for r in df.collect():
                seen[r["stem"]] = tuple(r)[1:]

        stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        for stem, version, scan, value in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[0], r[2], r[1])):
            v, s, n, total, resets = held.get(stem, (version, scan, 0, 0.0, 0))
            if v != version:
                if scan < s:
                    continue
                n, total, resets = 0, 0.0, resets + 1
            held[stem] = (version, max(s, scan), n + 1, total + (value or 0), resets)
        assert seen == held, k
    assert held["a"] == ("200", 3, 1, 10.0, 1) and held["b"] == ("9", 3, 4, 9.0, 1)


def test_names_that_are_ours(spark):
    names = ["chinh_1.jpg", "chinh_1.png", "Chinh_1.jpg", "xchinh_1.jpg", "title.txt", ".phu_1.jpg.ab.part", ".other.jpg.ab.part", "rieng_.jpg", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in df.where(delivery.ours(F.col("name"))).collect()] == ["chinh_1.jpg", ".phu_1.jpg.ab.part", "rieng_.jpg"]
