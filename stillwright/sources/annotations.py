"""Text sources: subtitles, moment files with directives, title lists, inventories, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwright.functions.text import composed, lines, stem, suffix, trimmed, without_markup
from stillwright.functions.timing import clock_seconds

#: Suffixes of videos, of texts beside them, of subtitles, of what is fetched, of the videos a
#: report pairs, of images; the folder of finished images; patterns of the lines of moment files.
VIDEO = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".flv")
SUBTITLE = (".srt", ".txt")
TIMED = (".srt", ".ass", ".vtt")
FETCHED = (".mp4", ".mkv", ".mov", ".srt", ".ass", ".vtt")
PAIRED = (".mp4", ".mkv", ".mov")
IMAGE = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
FINISHED = "xong"
MOMENT = r"^\s*((?:\d+:)?\d{1,2}:\d{2})\s+(.+?)\s*$"
CAST, EXTRA_CAST = r"(?iu)^\s*CAST\s*:\s*(.+?)\s*$", r"(?iu)^\s*PHU\s*:\s*(.+?)\s*$"
DESCRIBED, NUMBERED, TIMED_ROLE = r"(?iu)^\s*(nam|nu|nữ|[mf])\s*~?\s*(\d{1,2})\s*(.*?)\s*$", r"^\s*#\s*(\d{1,2})\s*(.*?)\s*$", r"^\s*@\s*((?:\d+:)?\d{1,2}:\d{2})\s+(.*?)\s*$"
SIMILARITY, GENRE = r"(?iu)^\s*SIM\s*:\s*([01]?\.\d+)\s*$", r"(?iu)^\s*THE[_ ]?LOAI\s*:\s*([a-z0-9]{1,4})\s*$"
EXTRA = r"(?iu)^\s*THEM\s*:\s*(vat|chung)\s+((?:\d+:)?\d{1,2}:\d{2})\s+(.+?)\s*$"
TIMECODE = r"^\s*(?:\d+:)?\d{1,2}:\d{2}[,.]\d{1,4}\s*-->"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc, text of each file, without a byte-order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select(stem(F.col("path")).alias("doc"), F.regexp_replace("value", "^﻿", "").alias("text"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, suffix, bytes of each file; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    return rows.select("path", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"), "bytes")


def sample(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated sample with # comments: views, channel, video_id, title."""
    return spark.read.csv(path, sep="\t", comment="#", schema="views bigint, channel string, video_id string, title string")


def dialogue(texts: DataFrame) -> DataFrame:
    """doc, pos, line of subtitle texts (doc, text): no indices, timecodes or markup, and no line equal to the one before it.

    A line of digits is an index only directly before a timecode; an index, a timecode and empty lines
    begin a block, so anything else stays.
    """
    each = texts.select("doc", F.posexplode(lines(F.regexp_replace("text", "^﻿", ""))).alias("pos", "raw"))
    w = Window.partitionBy("doc").orderBy("pos")
    each = each.withColumn("after", F.lead("raw").over(w))
    index = F.trim("raw").rlike(r"^\d+$") & F.coalesce(F.col("after").rlike(TIMECODE), F.lit(False))
    kept = each.where(~index & ~F.col("raw").rlike(TIMECODE)).select("doc", "pos", trimmed(without_markup(F.col("raw"))).alias("line")).where("line <> ''")
    return changed(kept, "doc", "pos", "line")


def changed(rows: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Rows whose line differs from the one before it."""
    before = F.lag(line).over(Window.partitionBy(key).orderBy(pos))
    return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(line)) | F.col("_b").isNull()).drop("_b")


def moment_lines(texts: DataFrame) -> DataFrame:
    """doc, line_no, line (in composed form) of moment files, without empty ones."""
    rows = texts.select("doc", F.posexplode(lines(F.col("text"))).alias("line_no", "line")).where(trimmed(F.col("line")) != "")
    return rows.select("doc", "line_no", composed(F.col("line")).alias("line"))


def moments(rows: DataFrame) -> DataFrame:
    """doc, line_no, sec, label of the lines '[H:]MM:SS label'."""
    found, label = (F.regexp_extract("line", MOMENT, i) for i in (1, 2))
    return rows.where(F.col("line").rlike(MOMENT)).select("doc", "line_no", clock_seconds(found).alias("sec"), label.alias("label"))


def story(found: DataFrame, beats: int = 5) -> DataFrame:
    """doc, line_no, sec, label, part of the first moments: the scene that is shown ('scene') and the next `beats` ('beat')."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("line_no")) - 1
    return found.withColumn("_n", place).where(F.col("_n") <= beats).withColumn("part", F.when(F.col("_n") == 0, "scene").otherwise("beat")).drop("_n")


def first_value(rows: DataFrame, pattern: str) -> DataFrame:
    """doc, value of the first line that fits the pattern of a directive, lowered; a line that does not fit doesn't win."""
    fits = rows.where(F.col("line").rlike(pattern))
    return fits.groupBy("doc").agg(F.min_by(F.lower(F.regexp_extract("line", pattern, 1)), F.col("line_no")).alias("value"))


def role_specs(rows: DataFrame, pattern: str = CAST, ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc, pos, kind, sex, n, label) of the first directive line with a valid entry, and (doc, line_no, entry)
    of the rejected entries of all lines up to it.

    Entries: '<sex> [~]<age> [label]' (desc), '# <n> [label]' (pin), '@ [H:]MM:SS label' (time); a line of
    numbers alone, if ids may be given, has places (id), of which repeated ones count once.
    """
    listed = F.filter(F.split(F.regexp_extract("line", pattern, 1), ","), lambda p: trimmed(p) != "")
    each = rows.where(F.col("line").rlike(pattern)).withColumn("entries", listed)
    digits = F.lit(ids) & (F.size("entries") > 0) & F.forall("entries", lambda p: trimmed(p).rlike(r"^\d+$"))
    each = each.select("doc", "line_no", digits.alias("ids"), F.posexplode("entries").alias("pos", "e"))
    e = F.col("e")
    part = lambda p, i: F.regexp_extract(e, p, i)
    kind = F.when(F.col("ids"), "id").when(e.rlike(TIMED_ROLE), "time").when(e.rlike(DESCRIBED), "desc").when(e.rlike(NUMBERED), "pin")
    n = F.when(F.col("kind") == "desc", part(DESCRIBED, 2).try_cast("int")).when(F.col("kind") == "pin", part(NUMBERED, 1).try_cast("int")).when(F.col("kind") == "time", clock_seconds(part(TIMED_ROLE, 1))).when(F.col("kind") == "id", trimmed(e).try_cast("int"))
    label = F.when(F.col("kind") == "desc", part(DESCRIBED, 3)).when(F.col("kind") == "pin", part(NUMBERED, 2)).when(F.col("kind") == "time", part(TIMED_ROLE, 2))
    sex = F.when(F.col("kind") == "desc", F.when(F.lower(part(DESCRIBED, 1)).isin("nam", "m"), "M").otherwise("F"))
    parsed = each.withColumn("kind", kind).select("doc", "line_no", "pos", trimmed(e).alias("entry"), "kind", sex.alias("sex"), n.alias("n"), F.nullif(label, F.lit("")).alias("label"))
    won = F.min(F.when(F.col("kind").isNotNull(), F.col("line_no"))).over(Window.partitionBy("doc"))
    parsed = parsed.withColumn("_won", won)
    mine = parsed.where("kind is not null and line_no = _won")
    again = F.row_number().over(Window.partitionBy("doc", "kind", "n").orderBy("pos")) > 1
    mine = mine.withColumn("_again", (F.col("kind") == "id") & again).where("not _again")
    refused = parsed.where("kind is null and (_won is null or line_no <= _won)").select("doc", "line_no", "entry")
    return mine.select("doc", "pos", "kind", "sex", "n", "label"), refused


def extras(rows: DataFrame) -> DataFrame:
    """doc, pos, kind, sec, label of all lines 'THEM: <kind> <time> <label>'."""
    part = lambda i: F.regexp_extract("line", EXTRA, i)
    return rows.where(F.col("line").rlike(EXTRA)).select("doc", F.col("line_no").alias("pos"), F.lower(part(1)).alias("kind"), clock_seconds(part(2)).alias("sec"), part(3).alias("label"))


def rejects(rows: DataFrame) -> DataFrame:
    """doc, line_no, line of what is neither a moment, a directive nor a comment."""
    line = F.col("line")
    known = line.rlike(r"^\s*#")
    for pattern in (MOMENT, CAST, EXTRA_CAST, SIMILARITY, GENRE, EXTRA):
        known = known | line.rlike(pattern)
    return rows.where(~known).select("doc", "line_no", "line")


def approved(spark: SparkSession, path: str, current: str = "") -> DataFrame:
    """film, pos, line of the title files <film>/title.txt below a path, but for the current film: no comments, no empty lines."""
    rows = spark.read.text(f"{path}/*/title.txt", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/title\.txt$", 1).alias("film"), "value")
    each = rows.select("film", F.posexplode(lines(F.regexp_replace("value", "^\ufeff", ""))).alias("pos", "line")).withColumn("line", trimmed(F.col("line")))
    return each.where((F.col("line") != "") & ~F.col("line").startswith("#") & (F.col("film") != current))


def keyframes(files: DataFrame, rate: Column) -> DataFrame:
    """files with frame_no and sec, of those whose stem is a number: in the order of the number, not of the text."""
    number = F.col("stem").try_cast("bigint")
    return files.withColumn("frame_no", number).where("frame_no is not null").withColumn("sec", F.col("frame_no") / rate)


def in_sequence(*scans: DataFrame) -> DataFrame:
    """The rows of several scans, one after the other: `scan` numbers them."""
    first, *rest = (df.withColumn("scan", F.lit(i)) for i, df in enumerate(scans))
    for df in rest:
        first = first.unionByName(df)
    return first


def named_only(files: DataFrame, names: list[str]) -> DataFrame:
    """Files whose stem is asked for; all if nothing is."""
    return files.where(F.col("stem").isin(names)) if names else files


def images(files: DataFrame) -> DataFrame:
    """Image files that are not below a folder of finished ones."""
    return files.where(F.col("suffix").isin(*IMAGE) & ~F.col("path").rlike(rf"(?:^|/){FINISHED}/"))


def to_fetch(listing: DataFrame, present: DataFrame) -> DataFrame:
    """Files of a listing (name, ...) of the kinds that are fetched, but those present (name, bytes) with some bytes."""
    there = present.where("bytes > 0").select("name")
    return listing.where(suffix(F.col("name")).isin(*FETCHED)).join(there, "name", "left_anti")


def paired(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """stem, subtitle of each video: .srt before .txt of the same stem; a lone video takes a lone subtitle of whatever
    name, moment files aside. All counts are of the whole inventory."""
    usable = subtitles.where(~F.col("stem").endswith(".moments"))
    w = Window.partitionBy("stem").orderBy(F.when(F.col("suffix") == ".srt", 0).otherwise(1), "path")
    first = usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("stem", F.col("path").alias("subtitle"))
    lone = usable.agg(F.when(F.count(F.lit(1)) == 1, F.max("path")).alias("_lone"))
    single = videos.agg((F.count(F.lit(1)) == 1).alias("_single"))
    both = videos.join(first, "stem", "left").crossJoin(F.broadcast(lone)).crossJoin(F.broadcast(single))  # one row each
    return both.withColumn("subtitle", F.coalesce("subtitle", F.when(F.col("_single"), F.col("_lone")))).drop("_lone", "_single")


def queue(items: DataFrame, present: DataFrame, key: str, pos: str, name: Column) -> DataFrame:
    """Items not present yet, subtitles before the rest, in order."""
    first = F.when(suffix(name).isin(*TIMED), 0).otherwise(1)
    return items.join(present.select(key), key, "left_anti").withColumn("priority", first)


def is_video(name: Column) -> Column:
    return suffix(name).isin(*VIDEO)
