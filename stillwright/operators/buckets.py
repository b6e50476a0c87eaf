"""Tiered quality gates of observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gates:
    """The bounds of the strict and the loose bucket, all inclusive."""

    width: float = 0.12
    det: float = 0.60
    sharp: float = 100.0
    yaw: float = 25.0
    roll: float = 20.0
    pitch: float = 22.0
    lips: float = 0.15
    loose_width: float = 0.06
    loose_det: float = 0.45
    loose_sharp: float = 40.0
    loose_yaw: float = 70.0


def relative_width(x1: Column, x2: Column, frame: Column) -> Column:
    return (x2 - x1) / frame


def inside(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 0.015) -> Column:
    """Whether a box keeps the margin on all sides; a box on the margin does not."""
    return (x1 > width * margin) & (y1 > height * margin) & (x2 < width * (1 - margin)) & (y2 < height * (1 - margin))


def angle(pose: Column, i: int) -> Column:
    return F.abs(F.coalesce(F.get(pose, F.lit(i)), F.lit(0.0)))


def bucket(g: Gates = Gates()) -> Column:
    """strict, loose or rejected, from w, det, sharp, yaw, roll, pitch, lip_gap, inside."""
    c = F.col
    strict = (c("w") >= g.width) & (c("det") >= g.det) & (c("sharp") >= g.sharp) & (c("yaw") <= g.yaw) & (c("roll") <= g.roll) & (c("pitch") <= g.pitch) & (c("lip_gap") >= g.lips) & c("inside")
    loose = (c("w") >= g.loose_width) & (c("det") >= g.loose_det) & (c("sharp") >= g.loose_sharp) & (c("yaw") <= g.loose_yaw)
    return F.when(strict, "strict").when(loose, "loose").otherwise("rejected")


def reason(g: Gates = Gates()) -> Column:
    """Why an observation is not strict: teeth before turned for loose ones, blurred for rejected ones."""
    c = F.col
    loose = F.when(c("lip_gap") < g.lips, "teeth").when((c("pitch") > g.pitch) | (c("yaw") > g.yaw), "turned")
    return F.when(c("bucket") == "loose", loose).when((c("bucket") == "rejected") & (c("sharp") < g.loose_sharp), "blurred")


def bucketed(faces: DataFrame, g: Gates = Gates()) -> DataFrame:
    return faces.withColumn("bucket", bucket(g)).withColumn("reason", reason(g))


def gated(faces: DataFrame, g: Gates = Gates()) -> DataFrame:
    """What the two early gates let through: the weaker bounds of both buckets, which a scan can push down."""
    first = faces.where((F.col("w") >= min(g.width, g.loose_width)) & (F.col("det") >= min(g.det, g.loose_det)) & (F.col("sharp") >= min(g.sharp, g.loose_sharp)))
    return first.where(F.col("yaw") <= max(g.yaw, g.loose_yaw))


def tally(faces: DataFrame, *keys: str) -> DataFrame:
    """The six counts of bucketed observations by keys."""
    n = lambda cond: F.count_if(cond)
    c = F.col
    return faces.groupBy(*keys).agg(
        n(c("bucket") == "strict").alias("strict"), n(c("bucket") == "loose").alias("loose"), n(c("bucket") == "rejected").alias("rejected"),
        n(F.coalesce(c("reason") == "blurred", F.lit(False))).alias("blurred"), n(F.coalesce(c("reason") == "turned", F.lit(False))).alias("turned"), n(F.coalesce(c("reason") == "teeth", F.lit(False))).alias("teeth"),
    )


#: What a face without the attribute counts as. A face whose width, detection or yaw is unknown has no quality.
NO_SHARP, NO_MOUTH = 0.0, 0.5


def _at_most(x: Column, bound: float) -> Column:
    """The lesser of the two; null stays null, which least and greatest pass over."""
    return F.when(x.isNotNull(), F.least(x, F.lit(bound)))


def _at_least(x: Column, bound: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(bound)))


def crispness(sharp: Column) -> Column:
    return F.least(F.coalesce(sharp, F.lit(NO_SHARP)) / 250.0, F.lit(1.0))


def straightness(yaw: Column) -> Column:
    return _at_least(1.0 - yaw / 25.0, 0.0)


def closed(mouth: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), F.coalesce(mouth, F.lit(NO_MOUTH)) - 0.40) / 0.40)


def face_score(det: Column, w: Column, sharp: Column, wanted: Column) -> Column:
    return det * (0.5 + w) * (0.4 + crispness(sharp)) * F.when(wanted, 1.6).otherwise(1.0)


def solo_quality(det: Column, w: Column, sharp: Column, yaw: Column, mouth: Column) -> Column:
    return det * (0.5 + w) * (0.4 + crispness(sharp)) * (0.6 + straightness(yaw)) * (0.55 + 0.45 * closed(mouth))


def group_quality(det: Column, w: Column, sharp: Column, yaw: Column) -> Column:
    return det * _at_most(w / 0.25, 1.0) * (0.4 + crispness(sharp)) * (0.6 + 0.4 * straightness(yaw))
