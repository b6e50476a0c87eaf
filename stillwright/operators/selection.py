"""Selection of stills: frame scores from faces, group and solo stills, stills by moments, coverage.

Faces are rows (keys of the frame, rank, strict, det, w, sharp, yaw, mouth, emb); rank is the place of
their identity among the roles, null for none. A face that is not strict counts where it has a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwright.functions.numbers import rounded
from stillwright.functions.vectors import dot
from stillwright.operators import buckets
from stillwright.operators.frames import solo_score
from stillwright.operators.greedy import Accepted, fold
from stillwright.operators.ranking import checkpointed

#: Rank of what has no role, seconds around a moment, least Hamming distance of two stills, group
#: stills, seconds between moments, share of the best score from which a still of two roles goes first.
UNKNOWN, AROUND, DISTANCE, GROUPS, MOMENT_GAP, DUO = 99, 120, 12, 2, 20, 0.75


def known_rank(rank: Column) -> Column:
    """The rank, or that of what has no role."""
    return F.coalesce(rank, F.lit(UNKNOWN))


def scored_frames(faces: DataFrame, keys: list[str], cast_size: int, n_roles: int) -> DataFrame:
    """keys, score, roles, n_faces, n_main, group_score, solos of every frame with a strict face.

    score: the best strict face's, raised by the number of main roles (rank below cast_size) beyond the
    first. roles: ranks below n_roles. n_faces: strict faces and others that have an identity. group_score:
    of the main roles the least of their best strict faces, 0 unless all are there. solos: rank and quality
    of each role's best strict face. One shuffle: both levels of sums are by frame.
    """
    c, rank = F.col, known_rank(F.col("rank"))
    strict = lambda x: F.when(c("strict"), x)
    roles = faces.repartition(*keys).groupBy(*keys, rank.alias("rank")).agg(
        F.count_if(c("strict") | c("rank").isNotNull()).alias("n"),
        F.max(strict(buckets.face_score(c("det"), c("w"), c("sharp"), rank < n_roles))).alias("face"),
        F.max(strict(buckets.group_quality(c("det"), c("w"), c("sharp"), c("yaw")))).alias("q"),
        F.max(strict(buckets.solo_quality(c("det"), c("w"), c("sharp"), c("yaw"), c("mouth")))).alias("solo"),
    )
    main = c("rank") < cast_size
    found = roles.groupBy(*keys).agg(
        F.max("face").alias("best"), F.array_sort(F.collect_list(F.when(c("rank") < n_roles, c("rank")))).alias("roles"), F.sum("n").alias("n_faces"), F.count_if(main).alias("n_main"),
        F.when((F.count_if(main & c("q").isNotNull()) == cast_size) & F.lit(cast_size > 0), rounded(F.min(F.when(main, c("q"))), 9)).otherwise(F.lit(0.0)).alias("group_score"),
        F.array_sort(F.collect_list(F.when((c("rank") < n_roles) & (c("solo") > 0), F.struct("rank", rounded("solo", 9).alias("q"))))).alias("solos"),
    ).where("best is not null")
    return found.withColumn("score", rounded(c("best") * (1 + F.greatest(F.lit(0), c("n_main") - 1)), 9)).drop("best")


def frames_with_group(frames: DataFrame, video: str) -> DataFrame:
    """video, n_group, most_main: how many frames show all main roles, and how many of them a frame shows at most."""
    return frames.groupBy(video).agg(F.count_if(F.col("group_score") > 0).alias("n_group"), F.max("n_main").alias("most_main"))


def with_group_places(frames: DataFrame, moments: DataFrame, video: str, frame: str) -> DataFrame:
    """frames with place: 1 to GROUPS for the group stills of each video, null for all others. These are frames that
    show all main roles, the best group score first, near the first moment (video, at) if any is; without such frames
    the one with most main roles. All is said by windows over a video, so frames move once."""
    c, all_ = F.col, Window.partitionBy(video)
    rows = frames.join(moments.select(video, "at"), video, "left").withColumn("_all", c("group_score") > 0)
    rows = rows.withColumn("_near", c("_all") & F.coalesce(F.abs(c("sec") - c("at")) <= AROUND, F.lit(False)))
    rows = rows.withColumn("_any", F.max("_all").over(all_)).withColumn("_any_near", F.max("_near").over(all_)).withColumn("_most", F.max("n_main").over(all_))
    rows = rows.withColumn("_fits", F.when(c("_any"), c("_all") & (c("_near") == c("_any_near"))).otherwise(c("n_main") == c("_most")))
    order = all_.orderBy(F.desc("_fits"), F.when(c("_any"), -c("group_score")), F.desc("score"), c(frame))
    rows = rows.withColumn("_n", F.row_number().over(order))
    place = F.when(c("_fits") & (c("_n") <= F.when(c("_any"), GROUPS).otherwise(1)), c("_n"))
    return rows.withColumn("place", place).drop("at", "_all", "_near", "_any", "_any_near", "_most", "_fits", "_n")


def stills(faces: DataFrame, frames: DataFrame, moments: DataFrame, video: str, frame: str, cast_size: int, n_roles: int) -> DataFrame:
    """video, role, idx, frame, q: group stills, then one solo still for each role.

    frames: `scored_frames` with sec and hash. A solo still is not the first group still and differs from
    all stills before it by DISTANCE bits; its quality is raised where nobody else is in the frame, and weighed by
    its likeness to the role's widest face in the first group still, if there is one. The choice for a role
    depends on those before it, so a video is one sorted run.

    Faces of roles are put into their frame's row, so all that follows is about frames of a video: they move by
    video once, for the windows and for the run.
    """
    c = F.col
    held = faces.where(c("rank") < n_roles).groupBy(video, frame).agg(F.collect_list(F.struct("rank", "strict", "w", (-c("pos")).alias("p"), "emb")).alias("_faces"))
    rows = with_group_places(frames.join(held, [video, frame], "left"), moments, video, frame)
    first = F.first(F.when(c("place") == 1, F.struct(c(frame).alias("frame"), c("_faces").alias("faces"))), True).over(Window.partitionBy(video))
    widest = lambda r: F.array_max(F.transform(F.filter("_first.faces", lambda f: f["rank"] == r), lambda f: F.struct(f["w"].alias("w"), f["p"].alias("p"), f["emb"].alias("emb"))))["emb"]
    main = F.array_distinct(F.transform(F.filter("_first.faces", lambda f: f["rank"] < cast_size), lambda f: f["rank"]))
    rows = rows.withColumn("_first", first).withColumn("_anchors", F.map_from_entries(F.transform(main, lambda r: F.struct(r.alias("rank"), widest(r).alias("emb")))))
    # one table of both: a frame's own row if it is a group still, and a row for each role it could be the solo still of
    both = rows.withColumn("_group", F.when(c("place").isNotNull(), F.array(F.struct(F.lit(-1).alias("who"), c("group_score").alias("q"), (-c("place")).cast("double").alias("score")))).otherwise(F.array()))
    solos = F.when(c(frame) != c("_first.frame"), F.transform("solos", lambda s: F.struct(s["rank"].cast("int").alias("who"), rounded(_solo_quality(s), 9).alias("q"), c("score").cast("double").alias("score"))))
    rows = both.withColumn("_e", F.explode(F.concat("_group", F.coalesce(solos, F.array())))).select(c(video).cast("long").alias(video), c(frame).cast("long").alias(frame), "_e.who", "hash", "_e.q", "_e.score")

    def step(state: Accepted, row: dict) -> list[tuple]:
        if row["who"] >= 0 and getattr(state, "done", None) == row["who"] or not state.fits(0, 0, row["hash"], DISTANCE):
            return []
        state.add(0, row["hash"])
        if row["who"] < 0:
            state.groups = getattr(state, "groups", 0) + 1
            return [(row[video], "group", state.groups, row[frame], row["q"])]
        state.done = row["who"]
        return [(row[video], "solo", row["who"] + 1, row[frame], row["q"])]

    # group stills come in their own order, solo candidates by quality
    order = [F.col("who"), F.when(F.col("who") < 0, -F.col("score")).otherwise(-F.col("q")), F.desc("score"), F.col(frame)]
    return fold(rows, [video], order, Accepted, step, f"{video} long, role string, idx int, {frame} long, q double")


def _solo_quality(solo: Column) -> Column:
    """Quality of a role's face in a frame (_faces, _anchors, n_faces), weighed by its likeness to the role's anchor."""
    anchor = F.try_element_at("_anchors", solo["rank"])
    like = F.array_max(F.transform(F.filter("_faces", lambda f: f["strict"] & (f["rank"] == solo["rank"])), lambda f: dot(f["emb"], anchor)))
    return solo_score(solo["q"], F.col("n_faces") == 1, F.when(anchor.isNotNull(), F.coalesce(like, F.lit(0.0))))


def without_replaced(stills: DataFrame, extras: DataFrame, doc: str) -> DataFrame:
    """stills without the group stills of works whose author has chosen some by hand (extras of kind 'chung')."""
    chosen = extras.where("kind = 'chung'").select(F.col("doc").alias(doc)).distinct().withColumn("_chosen", F.lit(True))
    return stills.join(chosen, doc, "left").where(F.col("_chosen").isNull() | (F.col("role") != "group")).drop("_chosen")


def moment_stills(frames: DataFrame, moments: DataFrame, video: str, frame: str, n: int, gap: float, around: float = AROUND) -> DataFrame:
    """video, frame, moment: of the first n moments (video, moment, at, in order of moment) the best frame within
    `around` seconds each, then the best others until there are n; moment is null for these.

    Of a moment the frames of two roles or more (duo) come first if the best of them has DUO of the best
    score. Frames keep MOMENT_GAP seconds (gap, if that is less) from those of other moments, and `gap` when filling up.
    """
    asked = moments.withColumn("_n", F.row_number().over(Window.partitionBy(video).orderBy("moment"))).where(F.col("_n") <= n).drop("_n")
    slot = F.explode(F.array(*[F.floor(F.col("at") / around) + i for i in (-1, 0, 1)]))
    pairs = frames.withColumn("_b", F.floor(F.col("sec") / around)).join(asked.withColumn("_b", slot), [video, "_b"]).where(F.abs(F.col("sec") - F.col("at")) <= around).drop("_b")
    best = pairs.groupBy(video, "moment").agg(F.max("score").alias("_best"), F.max(F.when(F.col("duo"), F.col("score"))).alias("_duo"))
    leads = F.coalesce(F.col("duo") & (F.col("_duo") >= DUO * F.col("_best")), F.lit(False))
    near = pairs.join(best, [video, "moment"]).select(video, frame, "sec", "hash", "score", F.col("moment").cast("long").alias("moment"), (~leads).alias("late"), F.lit(0).alias("phase"))
    rest = frames.select(video, frame, "sec", "hash", "score", F.lit(None).cast("long").alias("moment"), F.lit(False).alias("late"), F.lit(1).alias("phase"))

    def step(state: Accepted, row: dict) -> list[tuple]:
        if state.n >= n or row["moment"] is not None and getattr(state, "done", None) == row["moment"]:
            return []
        if not state.fits(row["sec"], min(gap, MOMENT_GAP) if row["phase"] == 0 else gap, row["hash"], DISTANCE):
            return []
        state.add(row["sec"], row["hash"])
        state.done = row["moment"] if row["phase"] == 0 else None
        return [(row[video], row[frame], row["moment"])]

    rows = near.unionByName(rest).withColumn(video, F.col(video).cast("long")).withColumn(frame, F.col(frame).cast("long"))
    return fold(rows, [video], [F.col("phase"), F.col("moment"), F.col("late"), F.desc("score"), F.col(frame)], Accepted, step, f"{video} long, {frame} long, moment long")


def role_mask(roles: Column) -> Column:
    """A set of roles 0 to 62 (an array) as the bits of a number."""
    return F.aggregate(roles, F.lit(0).cast("long"), lambda m, r: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), r.cast("int"))))


def has_role(mask: Column, role: Column) -> Column:
    return F.call_function("shiftright", mask, role).bitwiseAND(F.lit(1).cast("long")) == 1


def covering(frames: DataFrame, video: str, frame: str, mask: str, n_roles: int, n: int, gap: float, code: str | None = None, distance: int = DISTANCE) -> DataFrame:
    """video, idx, frame: n frames by score that keep `gap` seconds and, with hashes (code), `distance` bits; then for
    each of the roles below n_roles that no pick has, in order, the last one gives way to the best frame that has the
    role and keeps both from the others. A frame has a set of roles (mask, see `role_mask`).

    The greedy part streams. All but the last pick stay, so the best frame of each missing role is one join of
    them, n - 1 for a video, with the frames, and a minimum: nobody holds a video's frames.
    """
    def step(state: Accepted, row: dict) -> list[tuple]:
        if state.n >= n or not state.fits(row["sec"], gap, row["_code"], distance):
            return []
        state.add(row["sec"], row["_code"])
        return [(row[video], state.n, row[frame], row["sec"], row["_mask"], row["_code"], row["score"])]

    hashes = F.col(code).cast("long") if code else F.lit(None).cast("long")
    narrow = frames.select(F.col(video).cast("long").alias(video), F.col(frame).cast("long").alias(frame), "sec", "score", F.col(mask).cast("long").alias("_mask"), hashes.alias("_code"))
    picks = fold(narrow, [video], [F.desc("score"), F.col(frame)], Accepted, step, f"{video} long, place int, {frame} long, sec long, mask long, code long, score double")
    pick = F.struct("place", F.col(frame).alias("frame"), "sec", "mask", "code", "score")
    held = picks.groupBy(video).agg(F.array_sort(F.collect_list(pick)).alias("picks"))
    held = held.select(video, F.slice("picks", F.lit(1), F.size("picks") - 1).alias("rest"), F.element_at("picks", -1).alias("last"))
    held = checkpointed(held.withColumn("covered", F.aggregate("rest", F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(p["mask"]))))
    every = (1 << n_roles) - 1
    # videos whose other picks leave a role out, and frames that have such a role
    lacking = held.where(F.col("covered").bitwiseAND(every) != every).select(video, "rest", "covered")
    wanted = F.filter(F.sequence(F.lit(0), F.lit(n_roles - 1)), lambda r: has_role(F.col("_mask"), r) & ~has_role(F.col("covered"), r))
    apart = lambda p: (F.abs(p["sec"] - F.col("sec")) >= gap) & F.coalesce(F.bit_count(p["code"].bitwiseXOR(F.col("_code"))) >= distance, F.lit(True))
    found = narrow.join(lacking, video).where(F.forall("rest", apart)).withColumn("role", F.explode(wanted))
    found = found.groupBy(video, "role").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(frame).alias("frame"), F.col("_mask").alias("mask"))).alias("m"))
    found = found.groupBy(video).agg(F.map_from_entries(F.collect_list(F.struct("role", "m"))).alias("found"))

    def given(last: Column, role: Column) -> Column:
        new = F.try_element_at("found", role)
        return F.when(has_role(last["mask"].bitwiseOR(F.col("covered")), role) | new.isNull(), last).otherwise(new)

    start = F.struct((-F.col("last.score")).alias("s"), F.col("last.frame").alias("frame"), F.col("last.mask").alias("mask"))
    last = F.aggregate(F.sequence(F.lit(0), F.lit(n_roles - 1)), start, given)
    both = held.join(found, video, "left").select(video, "rest", last.alias("last"))
    all_ = F.concat(F.transform("rest", lambda p: F.struct((-p["score"]).alias("s"), p["frame"].alias("frame"))), F.array(F.struct(F.col("last.s").alias("s"), F.col("last.frame").alias("frame"))))
    return both.select(video, F.posexplode(F.array_sort(all_)).alias("idx", "p")).select(video, "idx", F.col("p.frame").alias(frame))
