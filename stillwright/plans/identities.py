"""Queries on identities: clustering, assignment, buckets, ranks, roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillwright.functions.numbers import rounded
from stillwright.functions.text import folded_name
from stillwright.functions.timing import seconds_of
from stillwright.functions.vectors import difference_hash, dot, hamming, norm, sign_hash
from stillwright.operators import buckets
from stillwright.operators.greedy import exclusive_matches, greedy_clusters, pinned
from stillwright.operators.identities import identities, listed, representatives
from stillwright.operators.matching import best_centroid, near_hashes
from stillwright.operators.ranking import author_numbers, cast_size, global_rank, moved_to_front
from stillwright.plans.registry import query, table

UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"

CLUSTERS_SQL = f"""
WITH RECURSIVE v AS (SELECT label::BIGINT AS video, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, {UNIT} AS e FROM embeddings),
s(video, i, vec_id, cid, sums) AS (
  SELECT DISTINCT video, 0::BIGINT, -1::BIGINT, -1::BIGINT, []::DOUBLE[][] FROM v
  UNION ALL
  SELECT v.video, v.i, v.vec_id, c.cid, CASE WHEN c.cid = len(s.sums) THEN list_append(s.sums, v.e)
         ELSE list_transform(s.sums, lambda t, k: CASE WHEN k - 1 = c.cid THEN list_transform(t, lambda x, j: x + v.e[j]) ELSE t END) END
  FROM s JOIN v ON v.video = s.video AND v.i = s.i + 1,
  LATERAL (SELECT list_transform(s.sums, lambda t: list_dot_product(t, v.e) / greatest(sqrt(list_dot_product(t, t)), 1e-12)) AS sims) q,
  LATERAL (SELECT CASE WHEN len(q.sims) > 0 AND list_max(q.sims) >= 0.20 THEN list_position(q.sims, list_max(q.sims)) - 1 ELSE len(s.sums) END AS cid) c
),
m AS (SELECT s.video, s.cid, e.event_type, e.value, e.event_id, floor(epoch(e.ts))::BIGINT AS sec FROM s JOIN events e ON e.event_id = s.vec_id WHERE s.i > 0),
t AS (SELECT video, cid::BIGINT AS cid, count(*)::BIGINT AS n, round(avg(value), 6) AS w_avg, round(sum(value), 6) AS score, coalesce(floor(quantile_cont(value, 0.5) FILTER (value > 0)), 0)::BIGINT AS age,
      min(sec)::BIGINT AS first_sec, max(sec)::BIGINT AS last_sec FROM m GROUP BY video, cid),
k AS (SELECT video, cid, event_type, row_number() OVER (PARTITION BY video, cid ORDER BY count(*) DESC, event_type) AS r FROM m GROUP BY video, cid, event_type),
id AS (SELECT t.*, k.event_type AS sex, (row_number() OVER (PARTITION BY t.video ORDER BY score DESC, t.cid) - 1)::BIGINT AS rank FROM t JOIN k ON k.video = t.video AND k.cid = t.cid AND k.r = 1)"""


def members(spark, sf_dir):
    """Clusters of the vectors of each work (label), with the events of the same ids as attributes."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("video"), "vec_id", "embedding")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "event_type", "value", seconds_of(F.col("ts")).alias("sec"))
    return greedy_clusters(vectors, "video", "vec_id", "embedding", 0.20).join(events, "vec_id").withColumn("cid", F.col("cid").cast("bigint"))


@query(CLUSTERS_SQL + " SELECT * FROM id")
def identity_table(spark, sf_dir):
    """Identities of each work: size, mean, sum, median, mode, span and rank."""
    return identities(members(spark, sf_dir), "video", "cid", "value", "sec", "event_type", "value")


@query(CLUSTERS_SQL + """, r AS (SELECT video, cid, event_id, row_number() OVER (PARTITION BY video, cid ORDER BY round(0.9::DOUBLE * (0.5::DOUBLE + value / 100) * least(value / 250, 1), 9) DESC, event_id) AS z FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY rank) AS z FROM id WHERE n >= 3)
SELECT l.video, l.cid, l.n, l.sex, l.age, l.rank, first_sec // 60 AS first_min, last_sec // 60 AS last_min, r.event_id AS face FROM l JOIN r ON r.video = l.video AND r.cid = l.cid AND r.z = 1 WHERE l.z <= 10""")
def face_table(spark, sf_dir):
    """The table of identities that is printed: those of three members and more, ten of a work, each with a face."""
    found = members(spark, sf_dir)
    faces = found.select("video", "cid", F.col("vec_id").alias("face"), F.col("vec_id").alias("pos"), F.lit(0.9).alias("det"), (F.col("value") / 100).alias("w"), F.col("value").alias("sharp"))
    table_ = listed(identities(found, "video", "cid", "value", "sec", "event_type", "value"), "video", least=3)
    return table_.join(representatives(faces, ["video", "cid"], "face", "pos"), ["video", "cid"]).select("video", "cid", "n", "sex", "age", "rank", "first_min", "last_min", "face")


@query(f"""WITH c AS (SELECT vec_id AS cid, {UNIT} AS v FROM embeddings WHERE vec_id < 10), i AS (SELECT vec_id, {UNIT} AS e FROM embeddings WHERE vec_id >= 10),
p AS (SELECT vec_id, cid, round(list_dot_product(e, v), 12) AS sim FROM i, c), b AS (SELECT vec_id, cid, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cid) AS r FROM p)
SELECT vec_id, CASE WHEN sim >= 0.2 THEN cid END::BIGINT AS cid, CASE WHEN sim >= 0.2 THEN round(sim, 6) END AS sim FROM b WHERE r = 1""")
def assign_to_centroid(spark, sf_dir):
    """Each vector to the most similar of ten centroids, if similar enough."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id < 10").select(F.col("vec_id").alias("cid"), F.col("embedding").cast("array<double>").alias("centroid"))
    return best_centroid(vectors.where("vec_id >= 10"), first, "vec_id", "embedding", 0.2).withColumn("sim", rounded("sim", 6))


def observations(spark, sf_dir):
    """Lines as observations: the bounds of the buckets cut through their values."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 100).alias("w"), (F.lit(1.0) - F.col("l_discount") * 7).alias("det"), (F.col("l_extendedprice") / 300).alias("sharp"), (F.col("l_tax") * 1000).alias("yaw"),
        (F.col("l_quantity") / 2).alias("roll"), (F.col("l_tax") * 400).alias("pitch"), (F.col("l_discount") * 3).alias("lip_gap"), (F.col("l_linenumber") < 7).alias("inside"), "l_returnflag",
    )


BUCKETS_SQL = """WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / 100 AS w, 1.0::DOUBLE - l_discount * 7 AS det, l_extendedprice / 300 AS sharp, l_tax * 1000 AS yaw, l_quantity / 2 AS roll, l_tax * 400 AS pitch, l_discount * 3 AS lip_gap, l_linenumber < 7 AS inside FROM lineitem),
b AS (SELECT *, CASE WHEN w >= 0.12 AND det >= 0.6::DOUBLE AND sharp >= 100 AND yaw <= 25 AND roll <= 20 AND pitch <= 22 AND lip_gap >= 0.15::DOUBLE AND inside THEN 'strict' WHEN w >= 0.06 AND det >= 0.45::DOUBLE AND sharp >= 40 AND yaw <= 70 THEN 'loose' ELSE 'rejected' END AS bucket FROM o)"""


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x1, CASE WHEN l_linenumber <> 7 THEN l_quantity + l_tax * 50 + 1 END AS x2, l_discount * 10 AS y1, l_discount * 20 + 30 AS y2, [l_tax * 300 - 12, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount * 100 END] AS pose, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 200 END AS sharp, CASE WHEN l_linenumber <> 4 THEN l_discount * 8 END AS mouth, 1.0::DOUBLE - l_discount AS det FROM lineitem),
p AS (SELECT *, (x2 - x1) / 60 AS w, abs(pose[1]) AS yaw, abs(coalesce(pose[2], 0)) AS pitch, least(coalesce(sharp, 0) / 250, 1) AS crisp, greatest(0, 1 - greatest(0, coalesce(mouth, 0.5::DOUBLE) - 0.4::DOUBLE) / 0.4::DOUBLE) AS shut FROM o), q AS (SELECT *, greatest(0, 1 - yaw / 25) AS straight FROM p)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(w, 9) AS w, x1 > 0.9::DOUBLE AND y1 > 0.75::DOUBLE AND x2 < 60 * (1 - 0.015::DOUBLE) AND y2 < 50 * (1 - 0.015::DOUBLE) AS inside, round(yaw, 9) AS yaw, round(pitch, 9) AS pitch, 0.0::DOUBLE AS roll,
round(crisp, 9) AS crisp, round(straight, 9) AS straight, round(shut, 9) AS shut, round(det * (0.5::DOUBLE + w) * (0.4::DOUBLE + crisp) * CASE WHEN l_linenumber <= 2 THEN 1.6::DOUBLE ELSE 1 END, 6) AS face,
round(det * (0.5::DOUBLE + w) * (0.4::DOUBLE + crisp) * (0.6::DOUBLE + straight) * (0.55::DOUBLE + 0.45::DOUBLE * shut), 6) AS solo, round(det * CASE WHEN w IS NOT NULL THEN least(w / 0.25::DOUBLE, 1) END * (0.4::DOUBLE + crisp) * (0.6::DOUBLE + 0.4::DOUBLE * straight), 6) AS grp FROM q""")
def face_features(spark, sf_dir):
    """Derived columns of faces: width, margin, pose angles, crispness, straightness, mouth and the three qualities."""
    c = F.col
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", c("l_quantity").alias("x1"), F.when(c("l_linenumber") != 7, c("l_quantity") + c("l_tax") * 50 + 1).alias("x2"), (c("l_discount") * 10).alias("y1"), (c("l_discount") * 20 + 30).alias("y2"),
        F.array(c("l_tax") * 300 - 12, F.when(c("l_linenumber") != 1, c("l_discount") * 100)).alias("pose"), F.when(c("l_linenumber") != 3, c("l_extendedprice") / 200).alias("sharp"), F.when(c("l_linenumber") != 4, c("l_discount") * 8).alias("mouth"), (F.lit(1.0) - c("l_discount")).alias("det"),
    )
    p = li.withColumn("w", buckets.relative_width(c("x1"), c("x2"), F.lit(60))).withColumn("yaw", buckets.angle(c("pose"), 0)).withColumn("pitch", buckets.angle(c("pose"), 1)).withColumn("roll", buckets.angle(c("pose"), 2))
    nine = lambda x, name: rounded(x, 9).alias(name)
    return p.select(
        "l_orderkey", "l_linenumber", "l_partkey", nine(c("w"), "w"), buckets.inside(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(60), F.lit(50)).alias("inside"), nine(c("yaw"), "yaw"), nine(c("pitch"), "pitch"), "roll",
        nine(buckets.crispness(c("sharp")), "crisp"), nine(buckets.straightness(c("yaw")), "straight"), nine(buckets.closed(c("mouth")), "shut"), rounded(buckets.face_score(c("det"), c("w"), c("sharp"), c("l_linenumber") <= 2), 6).alias("face"),
        rounded(buckets.solo_quality(c("det"), c("w"), c("sharp"), c("yaw"), c("mouth")), 6).alias("solo"), rounded(buckets.group_quality(c("det"), c("w"), c("sharp"), c("yaw")), 6).alias("grp"),
    )


@query(f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(e, list_reverse(e)), 6) AS turned FROM (SELECT vec_id, {UNIT} AS e FROM embeddings)")
def vector_norms(spark, sf_dir):
    """Length of each vector, and its product with itself turned round."""
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(norm(F.col("embedding")), 6).alias("norm"), rounded(dot(F.col("embedding"), F.reverse("embedding")), 6).alias("turned"))


@query(BUCKETS_SQL + """ SELECT l_returnflag, count(*) FILTER (bucket = 'strict')::BIGINT AS strict, count(*) FILTER (bucket = 'loose')::BIGINT AS loose, count(*) FILTER (bucket = 'rejected')::BIGINT AS rejected,
count(*) FILTER (bucket = 'rejected' AND sharp < 40)::BIGINT AS blurred, count(*) FILTER (bucket = 'loose' AND lip_gap >= 0.15::DOUBLE AND (pitch > 22 OR yaw > 25))::BIGINT AS turned, count(*) FILTER (bucket = 'loose' AND lip_gap < 0.15::DOUBLE)::BIGINT AS teeth FROM b GROUP BY l_returnflag""")
def bucket_tally(spark, sf_dir):
    return buckets.tally(buckets.bucketed(observations(spark, sf_dir)), "l_returnflag")


@query(BUCKETS_SQL + " SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, bucket FROM b WHERE bucket <> 'rejected'")
def gated_equals_full(spark, sf_dir):
    """The observations kept by the early gates and the full test are those that the full test alone keeps."""
    return buckets.bucketed(buckets.gated(observations(spark, sf_dir))).where("bucket <> 'rejected'").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "bucket")


@query(BUCKETS_SQL + " SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM b WHERE bucket = 'strict')")
def frame_requires_strict(spark, sf_dir):
    strict = buckets.bucketed(buckets.gated(observations(spark, sf_dir))).where("bucket = 'strict'")
    return table(spark, sf_dir, "orders").join(strict, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("""WITH k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type)
SELECT e.user_id, min(k.event_type) AS sex, floor(quantile_cont(value, 0.5) FILTER (value > 0))::BIGINT AS age FROM events e JOIN k ON k.user_id = e.user_id AND r = 1 GROUP BY e.user_id""")
def identity_mode_median(spark, sf_dir):
    """Mode (ties to the alphabetically first) and truncated median of the non-zero values."""
    e = table(spark, sf_dir, "events")
    kinds = e.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "event_type")).alias("k"))
    ages = e.where("value > 0").groupBy("user_id").agg(F.floor(F.percentile("value", 0.5)).cast("bigint").alias("age"))
    return kinds.select("user_id", F.col("k.event_type").alias("sex")).join(ages, "user_id", "left")


@query("""WITH s AS (SELECT s_nationkey::BIGINT AS grp, s_suppkey AS member, greatest(s_acctbal, 0) AS score FROM supplier),
t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, member) - 1 AS i, lag(score) OVER (PARTITION BY grp ORDER BY score DESC, member) AS p FROM s)
SELECT grp, greatest(2, coalesce(min(CASE WHEN score < 0.35::DOUBLE * p THEN i END), count(*)))::BIGINT AS cast_size FROM t WHERE i < 4 GROUP BY grp""")
def cast_size_cut(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("grp"), F.col("s_suppkey").alias("member"), F.greatest("s_acctbal", F.lit(0.0)).alias("score"))
    return cast_size(s, "grp", "score")


@query("SELECT c_custkey, c_acctbal, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1)::BIGINT AS rank FROM customer")
def rank_stable(spark, sf_dir):
    return global_rank(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")])


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank FROM supplier), p(pos, wanted) AS (VALUES (0, 3), (1, 0), (2, 7), (3, 3), (4, 100000)),
j AS (SELECT pos, wanted, s_suppkey, row_number() OVER (PARTITION BY wanted ORDER BY pos) AS n FROM p LEFT JOIN r ON r.rank = p.wanted)
SELECT pos::BIGINT AS pos, wanted::BIGINT AS wanted, CASE WHEN n = 1 THEN s_suppkey END AS s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'out of range' WHEN n > 1 THEN 'taken' ELSE 'matched' END AS status FROM j""")
def pin_by_position(spark, sf_dir):
    """Pins name places of the original ranking; places out of range or taken are reported."""
    ranked = global_rank(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.col("s_suppkey")])
    return pinned(spark.createDataFrame([(0, 3), (1, 0), (2, 7), (3, 3), (4, 100000)], "pos bigint, wanted bigint"), ranked, "s_suppkey")


@query("""WITH u AS (SELECT o_custkey, o_orderkey AS pos FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey, pos, row_number() OVER (PARTITION BY o_custkey ORDER BY pos)::BIGINT AS number FROM u""")
def author_order_number(spark, sf_dir):
    """Files of a work are numbered by the author's order over matched and pinned roles together."""
    orders = table(spark, sf_dir, "orders")
    roles = lambda only: orders.where(only).select("o_custkey", F.col("o_orderkey").alias("pos"))
    return author_numbers(roles("o_orderstatus = 'F'"), roles("o_orderpriority = '1-URGENT'"), "o_custkey", "pos")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer), k(c_custkey, tier, pos) AS (VALUES (5, 0, 0), (2, 0, 1), (90, 1, 0))
SELECT r.c_custkey, rank::BIGINT AS rank, (row_number() OVER (ORDER BY coalesce(tier, 99), coalesce(pos, 99), rank) - 1)::BIGINT AS new_rank FROM r LEFT JOIN k ON k.c_custkey = r.c_custkey""")
def reorder_front(spark, sf_dir):
    """Main roles, then secondary ones, then the rest in its order."""
    ranked = rank_stable(spark, sf_dir).drop("c_acctbal")
    picks = spark.createDataFrame([(5, 0, 0), (2, 0, 1), (90, 1, 0)], "c_custkey bigint, tier int, pos int")
    return moved_to_front(ranked, picks, "c_custkey").select("c_custkey", "rank", "new_rank")


SPECS = [(0, "BUILDING", 24), (1, "BUILDING", 24), (2, "MACHINERY", 60), (3, "FURNITURE", 95), (4, "NONE", 30), (5, "BUILDING", 24)]


@query("""WITH RECURSIVE c AS (SELECT c_nationkey::BIGINT AS work, c_custkey AS cid, c_mktsegment AS sex, floor((c_acctbal + 1000) / 120)::BIGINT AS age, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')),
s(pos, sex, age) AS (VALUES (0, 'BUILDING', 24), (1, 'BUILDING', 24), (2, 'MACHINERY', 60), (3, 'FURNITURE', 95), (4, 'NONE', 30), (5, 'BUILDING', 24)),
t(work, pos, taken, cid, status) AS (SELECT n_nationkey::BIGINT, -1, []::BIGINT[], NULL::BIGINT, '' FROM nation
  UNION ALL SELECT t.work, s.pos, CASE WHEN b.cid IS NULL THEN t.taken ELSE list_append(t.taken, b.cid) END, b.cid, coalesce(b.status, 'missing')
  FROM t JOIN s ON s.pos = t.pos + 1 LEFT JOIN LATERAL (SELECT c.cid, CASE WHEN abs(c.age - s.age) <= 10 THEN 'matched' ELSE 'fallback' END AS status FROM c WHERE c.work = t.work AND c.sex = s.sex AND NOT list_contains(t.taken, c.cid)
    ORDER BY abs(c.age - s.age) > 10, CASE WHEN abs(c.age - s.age) <= 10 THEN abs(c.age - s.age) // 5 ELSE 0 END, c.rank LIMIT 1) b ON true)
SELECT work, pos::BIGINT AS pos, cid, status FROM t WHERE pos >= 0""")
def role_match_tiered(spark, sf_dir):
    """In each nation role descriptions take customers without replacement: same segment, tiers of five years,
    then rank; those that other roles use already are no candidates."""
    used = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("cid")).distinct()
    free = table(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("cid"), "left_anti")
    best = Window.partitionBy("work").orderBy(F.desc("c_acctbal"), "cid")
    pool = free.select(F.col("c_nationkey").cast("bigint").alias("work"), F.col("c_custkey").alias("cid"), F.col("c_mktsegment").alias("sex"), F.floor((F.col("c_acctbal") + 1000) / 120).cast("int").alias("age"), "c_acctbal")
    pool = pool.withColumn("rank", F.row_number().over(best) - 1)
    specs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("work")).join(F.broadcast(spark.createDataFrame(SPECS, "pos int, sex string, age int")), how="cross")  # six rows
    return exclusive_matches(specs, pool).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings), s AS (SELECT vec_id, list_sum(list_transform(b, lambda x, i: CASE WHEN x THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END))::UBIGINT AS h FROM h)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) < 20""")
def hash_near_pairs(spark, sf_dir):
    """Pairs whose sign hashes differ in fewer than 20 of 64 bits."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", sign_hash(F.col("embedding")).alias("h"))
    return near_hashes(h, "vec_id", "h", 20)


@query(f"""WITH g AS (SELECT vec_id, {UNIT} AS e FROM embeddings), c AS (SELECT vec_id, unnest(range(0, 64)) AS i, e || e AS e FROM g),
h AS (SELECT vec_id, sum(CASE WHEN e[i // 8 * 9 + i % 8 + 2] > e[i // 8 * 9 + i % 8 + 1] THEN 1::HUGEINT << i::INT ELSE 0 END)::UBIGINT AS h FROM c GROUP BY vec_id)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) < 18""")
def grid_near_pairs(spark, sf_dir):
    """Pairs of grids of 8 x 9 values whose difference hashes differ in fewer than 18 of 64 bits."""
    e = F.concat("embedding", "embedding")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(e, y * 9 + 1, 9))
    return near_hashes(table(spark, sf_dir, "embeddings").select("vec_id", difference_hash(grid).alias("h")), "vec_id", "h", 18)


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS word FROM documents), k AS (SELECT word FROM w WHERE regexp_full_match(word, '[A-Za-zÀ-ÖØ-öø-ÿ]+'))
SELECT word, replace(upper(substr(strip_accents(word), 1, 1)), 'ẞ', 'SS') || substr(strip_accents(word), 2) AS folded FROM k""")
def accent_fold(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where(F.col("word").rlike("^[A-Za-zÀ-ÖØ-öø-ÿ]+$")).distinct()
    return words.select("word", folded_name(F.col("word")).alias("folded"))
