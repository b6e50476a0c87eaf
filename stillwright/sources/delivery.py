"""Delivery of chosen files into folders that people also use: what changes, distributed copies, and a commit.

A folder holds files of ours (by their prefixes and suffix) and files of its owner. A delivery copies what is
planned and not there yet, and only when all copies are done deletes what is ours and no longer planned. Copies
run in tasks, each under a temporary name until it is whole, so a delivery that was broken off is done again and
ends in the same folder; one that is repeated changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwright.operators.ranking import checkpointed

#: Names that are ours, past ones too.
PREFIXES, SUFFIX = ("canh_chung_", "chinh_", "phu_", "vat_", "chung_", "rieng_"), ".jpg"
#: Ends the temporary name of a copy; such files are ours as well. Bytes that a copy holds at a time.
PART, CHUNK = ".part", 1 << 20
REPORT = "folder string, dest string, status string, bytes long"


def ours(name: Column) -> Column:
    """Whether a file is one of ours: a prefix and the suffix, or a copy that was broken off."""
    known = F.lit(False)
    for p in PREFIXES:
        known = known | name.startswith(p) | (name.startswith("." + p) & name.endswith(PART))
    return known & (name.endswith(SUFFIX) | name.endswith(PART))


def changes(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """folder, dest, src, status of planned files (folder, dest, src, bytes) against what is there (folder, name, bytes).

    copy: not there, or of another size; keep: there; delete: ours and not planned. Files of the owner have no row. Of
    several sources for one name the greatest counts. Null folders and names have no row.
    """
    wanted = plan.where("folder is not null and dest is not null").groupBy("folder", "dest").agg(F.max(F.struct("src", "bytes")).alias("_w"))
    there = inventory.where("folder is not null and name is not null").groupBy("folder", F.col("name").alias("dest")).agg(F.max("bytes").alias("_there"))
    both = wanted.join(there, ["folder", "dest"], "full")
    status = F.when(F.col("_w").isNull(), F.when(ours(F.col("dest")), "delete")).when(F.coalesce(F.col("_there") == F.col("_w.bytes"), F.lit(False)), "keep").otherwise("copy")
    return both.select("folder", "dest", F.col("_w.src").alias("src"), status.alias("status")).where("status is not null")


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI, or of a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _report(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in REPORT.split(", ")])


def listed(folders: DataFrame) -> DataFrame:
    """folder, name, bytes of the files in each folder (folder); a folder that isn't there has none. Tasks list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                store, path = _at(folder)
                found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
                rows += [(folder, x.base_name, x.size) for x in found if x.type == fs.FileType.File]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["folder", "name", "bytes"])

    return folders.select("folder").where("folder is not null").distinct().mapInArrow(run, "folder string, name string, bytes long")


def _same(a: fs.FileSystem, left: str, b: fs.FileSystem, right: str) -> bool:
    """Whether two files of one size hold the same bytes."""
    with a.open_input_stream(left) as x, b.open_input_stream(right) as y:
        while True:
            p, q = x.read(CHUNK), y.read(CHUNK)
            if p != q:
                return False
            if not p:
                return True


def _copied(src: str, folder: str, dest: str) -> tuple[str, int]:
    """copied or kept, and the bytes of the file; missing where there is no source."""
    (a, source), (b, target) = _at(src), _at(f"{folder}/{dest}")
    info, there = a.get_file_info(source), b.get_file_info(target)
    if info.type != fs.FileType.File:
        return "missing", 0
    if there.type == fs.FileType.File and there.size == info.size and _same(a, source, b, target):
        return "kept", info.size
    b.create_dir(_at(folder)[1], recursive=True)
    part = f"{target.rpartition('/')[0]}/.{dest}.{uuid.uuid4().hex}{PART}"
    try:
        with a.open_input_stream(source) as x, b.open_output_stream(part) as y:
            while block := x.read(CHUNK):
                y.write(block)
        b.move(part, target)
    except BaseException:
        if b.get_file_info(part).type == fs.FileType.File:
            b.delete_file(part)
        raise
    return "copied", info.size


def deliver(plan: DataFrame) -> DataFrame:
    """folder, dest, status, bytes of every file of ours after a delivery of plan (folder, dest, src).

    status: copied, kept (it was there already), missing (there is no such source; nothing of that name is
    changed), deleted. First all copies, then the deletions: a delivery that fails has deleted nothing, and is done
    again by calling it again. The owner's files stay, whatever they are. Of several sources for one name the
    greatest counts. Paths are local or URIs of any store that pyarrow knows. Folders are not shared between deliveries.
    """
    wanted = plan.where("folder is not null and dest is not null and src is not null").groupBy("folder", "dest").agg(F.max("src").alias("src"))
    wanted = checkpointed(wanted)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(folder, dest, *_copied(src, folder, dest)) for folder, dest, src in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _report(rows)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = _at(f"{folder}/{name}")
                if store.get_file_info(path).type == fs.FileType.File:
                    store.delete_file(path)
                rows.append((folder, name, "deleted", 0))
            if rows:
                yield _report(rows)

    copied = checkpointed(wanted.select("folder", "dest", "src").repartition("folder", "dest").mapInArrow(copy, REPORT))
    there = listed(wanted.select("folder").unionByName(plan.select("folder")))
    stale = there.where(ours(F.col("name"))).join(wanted.select("folder", F.col("dest").alias("name")), ["folder", "name"], "left_anti").select("folder", "name")
    return copied.unionByName(checkpointed(stale.mapInArrow(delete, REPORT)))
