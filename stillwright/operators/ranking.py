"""Ranks over a whole table without a single task, and order by position."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Picks that go to every task at most.
BROADCAST_PICKS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, or one of our own where none is set and all tasks run
    on this machine (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A rank from 0 over all rows, in a total order.

    Rows are range-partitioned and numbered inside their partitions; the partitions' counts, one row
    each, give the offsets. No task sees more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_part", F.call_function("shiftright", F.col("_id"), F.lit(33))).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_id", "_in", "_before")


def carried(rows: DataFrame, group: list[str], order: list[str], value: str, back: str | None = None) -> DataFrame:
    """rows with `value` filled by the last one at or before each row of its group in the order and, if `back` is
    given, with a column of that name: the first one at or after it. Nulls are what is filled.

    Rows are range-partitioned by group and order, so a large group is split; windows run within a group's
    part of a partition. A group has what it carries over from one partition to the next in one row each, and
    only groups that cross an edge have any. A fixed number of jobs.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = checkpointed(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    known = F.when(F.col(value).isNotNull(), F.struct(*order, value))
    edges = placed.groupBy("_part", *group).agg(F.min(known).alias("_first"), F.max(known).alias("_last"))
    each = Window.partitionBy(*group)
    # groups that are in several partitions: two rows a partition at most
    edges = edges.withColumn("_n", F.count(F.lit(1)).over(each)).where("_n > 1")
    # frames that grow from the start of a sorted run are sums; those that shrink to its end are read anew for each row, so
    # what follows is what comes before in the opposite order
    before, after = (Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1) for by in (F.asc("_part"), F.desc("_part")))
    edges = edges.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.last(f"_last.{value}", True).over(before).alias("_before"), F.last(f"_first.{value}", True).over(after).alias("_after"))
    inside = Window.partitionBy("_part", *group)
    upto = lambda by: F.last(value, True).over(inside.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_back", upto([F.desc(c) for c in order])) if back else placed
    out = out.withColumn(value, upto(order))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    out = out.join(F.broadcast(edges), same, "left")
    out = out.withColumn(value, F.coalesce(value, "_before"))
    return (out.withColumn(back, F.coalesce("_back", "_after")) if back else out).drop("_part", "_p", *[f"_g{i}" for i in range(len(group))], "_before", "_after", "_back")


def moved_to_front(ranked: DataFrame, picks: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """new_rank: picks (key, tier, pos) come first by tier and position, the rest keep their order."""
    few = picks.count() <= BROADCAST_PICKS
    both = ranked.join(F.broadcast(picks) if few else picks, key, "left")
    return global_rank(both, [F.coalesce("tier", F.lit(2**31 - 1)), F.coalesce("pos", F.lit(2**31 - 1)), F.col(rank)], "new_rank")


def cast_size(scores: DataFrame, group: str, score: str, cap: int = 4, drop: float = 0.35, least: int = 2) -> DataFrame:
    """group, cast_size: of the `cap` best scores, as many as come before the first drop below `drop` times the one before; `least` at least."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "member")
    top = scores.withColumn("i", F.row_number().over(w) - 1).where(F.col("i") < cap).withColumn("before", F.lag(score).over(w))
    cut = F.min(F.when(F.col(score) < drop * F.col("before"), F.col("i")))
    return top.groupBy(group).agg(F.greatest(F.lit(least), F.coalesce(cut, F.count(F.lit(1)).cast("int"))).cast("long").alias("cast_size"))


def numbered_extras(extras: DataFrame, chosen: DataFrame) -> DataFrame:
    """number of each extra (doc, pos, kind): counted by kind; those of kind 'chung' go on after the automatic group stills in chosen (doc, role)."""
    w = Window.partitionBy("doc", "kind").orderBy("pos")
    taken = chosen.where("role = 'chung'").groupBy("doc").agg(F.count(F.lit(1)).alias("_taken"))
    out = extras.withColumn("_n", F.row_number().over(w)).join(taken, "doc", "left")
    return out.withColumn("number", F.col("_n") + F.when(F.col("kind") == "chung", F.coalesce("_taken", F.lit(0))).otherwise(0)).drop("_n", "_taken")


def author_numbers(matched: DataFrame, pinned: DataFrame, work: str, pos: str) -> DataFrame:
    """work, pos, number: from 1 in the author's order over matched and pinned roles together."""
    both = matched.select(work, pos).unionByName(pinned.select(work, pos)).distinct()
    return both.withColumn("number", F.row_number().over(Window.partitionBy(work).orderBy(pos)).cast("bigint"))
