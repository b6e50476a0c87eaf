"""Tables of identities: sizes, spans, representatives, and which of them are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwright.functions.numbers import rounded
from stillwright.operators import buckets


def identities(members: DataFrame, work: str, cid: str, width: str, sec: str, sex: str, age: str) -> DataFrame:
    """work, cid, n, w_avg, score, sex, age, first_sec, last_sec, rank of each identity.

    score: the summed widths; rank by score within the work, the least cid of equals. sex: the mode, of
    equals the first by alphabet, '?' for none. age: the median of those above 0, truncated; 0 for none.
    """
    sexes = members.where(F.col(sex).isNotNull()).groupBy(work, cid, sex).count().groupBy(work, cid).agg(F.min(F.struct((-F.col("count")).alias("n"), sex)).alias("_k")).select(work, cid, F.col(f"_k.{sex}").alias("sex"))
    # the median by two combinable sums: how often each age occurs, then the ages at the two middle places
    by_age = members.where(F.col(age) > 0).groupBy(work, cid, age).agg(F.count(F.lit(1)).alias("_c"))
    upto, all_ = Window.partitionBy(work, cid).orderBy(age), Window.partitionBy(work, cid)
    middle = by_age.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(all_)).groupBy(work, cid)
    place = lambda k: F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - k) / 2), F.col(age)))
    ages = middle.agg(F.floor((place(1) + place(0)) / 2).cast("bigint").alias("age"))
    rows = members.groupBy(work, cid).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(width), 6).alias("w_avg"), rounded(F.sum(width), 6).alias("score"),
        F.min(sec).alias("first_sec"), F.max(sec).alias("last_sec"),
    )
    best = Window.partitionBy(work).orderBy(F.desc("score"), cid)  # a work has tens of identities, not members
    rows = rows.join(ages, [work, cid], "left").withColumn("age", F.coalesce("age", F.lit(0).cast("bigint")))
    return rows.join(sexes, [work, cid], "left").withColumn("sex", F.coalesce("sex", F.lit("?"))).withColumn("rank", (F.row_number().over(best) - 1).cast("bigint"))


def representatives(faces: DataFrame, keys: list[str], face: str, pos: str) -> DataFrame:
    """keys, face: of each identity the face that is detected, large and sharp; the first of equals."""
    worth = F.col("det") * (0.5 + F.col("w")) * buckets.crispness(F.col("sharp"))
    return faces.groupBy(*keys).agg(F.max_by(face, F.struct(rounded(worth, 9), (-F.col(pos)).alias("p"))).alias(face))


def listed(table: DataFrame, work: str, least: int = 8, most: int = 10) -> DataFrame:
    """Identities of at least `least` members, the `most` best of a work, with the minutes of their span."""
    best = Window.partitionBy(work).orderBy("rank")
    kept = table.where(F.col("n") >= least).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")
    minutes = lambda c: F.floor(F.col(c) / 60).cast("bigint")
    return kept.withColumn("first_min", minutes("first_sec")).withColumn("last_min", minutes("last_sec"))


def with_ranks(faces: DataFrame, table: DataFrame, work: str) -> DataFrame:
    """Faces (work, cid, ...) with the rank of their identity; null for faces without one."""
    return faces.join(table.select(work, "cid", "rank"), [work, "cid"], "left")
