"""Queries on scans: files and links, moment files and subtitles that are built from rows, layout, pixels, landmarks.

The texts of a work are lines made from its rows, so that what they must read as is known from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwright.functions import layout, vectors
from stillwright.functions import text as t
from stillwright.functions.numbers import rounded
from stillwright.functions.timing import backoff, frame_rate, hms, minutes_mark
from stillwright.operators.ranking import numbered_extras
from stillwright.plans.registry import query, table
from stillwright.sources import annotations as a
from stillwright.sources import delivery, sinks

CLOCK = "printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)"
#: An order is a line of its customer's file; what kind of line, its key says.
LINES = f"""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 9 AS kind, o_orderkey * 37 % 30000 + 3600 AS s, 1 + o_orderkey % 60 AS n, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS line_no FROM orders),
l AS (SELECT *, {CLOCK} AS clock FROM o)"""


def moment_texts(spark, sf_dir):
    """doc, text: a moment file of each customer."""
    c = F.col
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("doc"), c("o_orderkey").alias("k"), (c("o_orderkey") * 37 % 30000 + 3600).alias("s"), (1 + c("o_orderkey") % 60).cast("string").alias("n"))
    k, clock = c("k").cast("string"), hms(c("s"))
    line = [
        F.concat(clock, F.lit("  Cảnh "), k, F.lit(" ")), F.concat(F.lit("# note "), k), F.concat(F.lit("cast: nam~"), c("n"), F.lit(" A"), k, F.lit(", # 7 P, oops "), k, F.lit(",, @ "), clock, F.lit(" T")),
        F.concat(F.lit("SIM: 0."), c("n")), F.concat(F.lit("THE LOAI: G"), F.col("k") % 100), F.concat(F.lit("THEM: VAT "), clock, F.lit(" key "), k), F.concat(F.lit("PHU: NỮ "), c("n"), F.lit(", 3, m 5 B")),
        F.concat(F.lit("stray "), k), F.concat(F.lit("CAST: "), k, F.lit(" none")),
    ]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\r\n")
    return o.withColumn("line", F.element_at(F.array(*line), (F.col("k") % 9 + 1).cast("int"))).groupBy("doc").agg(text.alias("text"))


def moment_rows(spark, sf_dir):
    return a.moment_lines(moment_texts(spark, sf_dir))


@query(LINES + " SELECT doc, line_no, s::BIGINT AS sec, 'Cảnh ' || k AS label FROM l WHERE kind = 0")
def moment_scenes(spark, sf_dir):
    """The moments of each file: seconds and label."""
    return a.moments(moment_rows(spark, sf_dir)).select("doc", F.col("line_no").cast("bigint").alias("line_no"), F.col("sec").cast("bigint").alias("sec"), "label")


@query(LINES + ", m AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1 AS i FROM l WHERE kind = 0) SELECT doc, k AS scene, CASE WHEN i = 0 THEN 'scene' ELSE 'beat' END AS part FROM m WHERE i <= 2")
def moment_story(spark, sf_dir):
    """The scene that is shown, and the next two."""
    story = a.story(a.moments(moment_rows(spark, sf_dir)), 2)
    return story.select("doc", F.regexp_extract("label", r"(\d+)$", 1).cast("bigint").alias("scene"), "part")


@query(LINES + """, s AS (SELECT doc, arg_min('0.' || n, line_no) AS sim FROM l WHERE kind = 3 GROUP BY doc), g AS (SELECT doc, arg_min('g' || k % 100, line_no) AS genre FROM l WHERE kind = 4 GROUP BY doc)
SELECT doc, sim, genre FROM s FULL JOIN g USING (doc)""")
def moment_settings(spark, sf_dir):
    """The first similarity and the first genre of each file."""
    rows = moment_rows(spark, sf_dir)
    sim, genre = (a.first_value(rows, p).withColumnRenamed("value", n) for p, n in ((a.SIMILARITY, "sim"), (a.GENRE, "genre")))
    return sim.join(genre, "doc", "full").select("doc", "sim", "genre")


CAST_SQL = LINES + """, w AS (SELECT * FROM l WHERE kind = 2 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY line_no) = 1), p AS (SELECT * FROM l WHERE kind = 6 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY line_no) = 1)"""


@query(CAST_SQL + """ SELECT doc, 'main' AS cast_of, 0 AS pos, 'desc' AS kind, 'M' AS sex, n::BIGINT AS n, 'A' || k AS label FROM w UNION ALL SELECT doc, 'main', 1, 'pin', NULL, 7, 'P' FROM w UNION ALL SELECT doc, 'main', 3, 'time', NULL, s, 'T' FROM w
UNION ALL SELECT doc, 'extra', 0, 'desc', 'F', n, NULL FROM p UNION ALL SELECT doc, 'extra', 2, 'desc', 'M', 5, 'B' FROM p""")
def moment_cast(spark, sf_dir):
    """The roles of the first valid line of the main cast and of the first one of the extras, in the author's order."""
    rows = moment_rows(spark, sf_dir)
    both = [a.role_specs(rows, p, ids)[0].withColumn("cast_of", F.lit(n)) for p, ids, n in ((a.CAST, True, "main"), (a.EXTRA_CAST, False, "extra"))]
    return both[0].unionByName(both[1]).select("doc", "cast_of", F.col("pos").cast("int").alias("pos"), "kind", "sex", F.col("n").cast("bigint").alias("n"), "label")


@query(CAST_SQL + """, f AS (SELECT l.doc, l.line_no, l.k, l.kind FROM l LEFT JOIN w ON w.doc = l.doc WHERE l.kind IN (2, 8) AND (w.line_no IS NULL OR l.line_no <= w.line_no))
SELECT doc, line_no, CASE WHEN kind = 2 THEN 'oops ' || k ELSE k || ' none' END AS entry FROM f""")
def moment_cast_refused(spark, sf_dir):
    """Entries of cast lines that say nothing, up to the line that wins."""
    return a.role_specs(moment_rows(spark, sf_dir))[1].select("doc", F.col("line_no").cast("bigint").alias("line_no"), "entry")


EXTRAS_SQL = LINES + ", x AS (SELECT doc, line_no AS pos, CASE WHEN n % 2 = 0 THEN 'vat' ELSE 'chung' END AS kind FROM l WHERE kind = 5), c AS (SELECT doc, count(*) AS taken FROM l WHERE kind = 0 GROUP BY doc)"


@query(LINES + " SELECT doc, line_no AS pos, 'vat' AS kind, s::BIGINT AS sec, 'key ' || k AS label FROM l WHERE kind = 5")
def moment_extras(spark, sf_dir):
    return a.extras(moment_rows(spark, sf_dir)).select("doc", F.col("pos").cast("bigint").alias("pos"), "kind", F.col("sec").cast("bigint").alias("sec"), "label")


@query(EXTRAS_SQL + """ SELECT doc, pos, kind, (row_number() OVER (PARTITION BY doc, kind ORDER BY pos) + CASE WHEN kind = 'chung' THEN coalesce(taken, 0) ELSE 0 END)::BIGINT AS number FROM x LEFT JOIN c USING (doc)""")
def extra_numbers(spark, sf_dir):
    """Numbers of the stills that an author adds: shared ones go on after those that are chosen already."""
    rows = moment_rows(spark, sf_dir)
    added = a.extras(rows).withColumn("kind", F.when(F.regexp_extract("label", r"(\d+)$", 1).cast("bigint") % 60 % 2 == 1, "vat").otherwise("chung"))
    chosen = a.moments(rows).select("doc", F.lit("chung").alias("role"))
    return numbered_extras(added, chosen).select("doc", F.col("pos").cast("bigint").alias("pos"), "kind", F.col("number").cast("bigint").alias("number"))


@query(LINES + " SELECT doc, line_no, 'stray ' || k AS line FROM l WHERE kind = 7")
def moment_rejects(spark, sf_dir):
    """Lines that are no moment, directive or comment."""
    return a.rejects(moment_rows(spark, sf_dir)).select("doc", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_id::VARCHAR ELSE event_type END AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
b AS (SELECT *, lag(line) OVER (PARTITION BY user_id ORDER BY i) AS before FROM e) SELECT user_id AS doc, (4 * i + 2)::BIGINT AS pos, line FROM b WHERE line IS DISTINCT FROM before""")
def subtitle_lines(spark, sf_dir):
    """Subtitles of each user's events: no numbers of blocks, timecodes or markup, a line of digits stays, repeated lines go."""
    block = F.concat(F.lit("1\r\n00:00:01,000 --> 00:00:02,500\r\n <i>"), F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type")), F.lit("</i>{\\an8}\r\n\r\n"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", block.alias("b"))
    texts = e.groupBy(F.col("user_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "b"))), lambda x: x["b"]), "").alias("text"))
    return a.dialogue(texts).select("doc", F.col("pos").cast("bigint").alias("pos"), "line")


SUFFIXES = (".mp4", ".MKV", ".jpg", ".PNG", ".srt", ".ass", ".txt", ".webm", "")
FILES_SQL = f"""WITH f AS (SELECT p_partkey AS k, 'in/' || CASE WHEN p_size % 4 = 0 THEN 'xong/' ELSE '' END AS folder, CASE WHEN p_size % 7 = 0 THEN 'clip.' || p_partkey ELSE '0' || p_partkey END AS stem,
  [{", ".join(f"'{s}'" for s in SUFFIXES)}][1 + p_partkey % {len(SUFFIXES)}] AS ext, p_size AS bytes FROM part), g AS (SELECT *, CASE WHEN ext = '' AND starts_with(stem, 'clip.') THEN 'clip' ELSE stem END AS st, CASE WHEN ext = '' AND starts_with(stem, 'clip.') THEN stem[5:] ELSE lower(ext) END AS su FROM f)"""


def files(spark, sf_dir):
    """k, path, stem, suffix, bytes of files that are named by parts."""
    c = F.col
    ext = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (c("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("in/"), F.when(c("p_size") % 4 == 0, "xong/").otherwise(""), F.when(c("p_size") % 7 == 0, "clip.").otherwise("0"), c("p_partkey").cast("string"), ext)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), path.alias("path"), c("p_size").cast("bigint").alias("bytes")).withColumn("stem", t.stem(c("path"))).withColumn("suffix", t.suffix(c("path")))


@query(FILES_SQL + """ SELECT k, st AS stem, su AS suffix, su IN ('.mp4', '.mkv', '.webm') AS video, su IN ('.jpg', '.png') AND folder = 'in/' AS image, starts_with(stem, 'clip.') AND st = 'clip.27' AS asked FROM g""")
def media_files(spark, sf_dir):
    """Stem and suffix of each file; which are videos, which images that are not finished, which are asked for."""
    f = files(spark, sf_dir)
    image, asked = (df.select("k", F.lit(True).alias(n)) for df, n in ((a.images(f), "image"), (a.named_only(f, ["clip.27"]), "asked")))
    out = f.withColumn("video", a.is_video(F.col("path"))).join(image, "k", "left").join(asked, "k", "left")
    return out.select("k", "stem", "suffix", "video", F.coalesce("image", F.lit(False)).alias("image"), F.coalesce("asked", F.lit(False)).alias("asked"))


RATES = ("30000/1001", "25", "0/0", "abc", "24/1")


@query(FILES_SQL + """, r AS (SELECT *, [30000.0::DOUBLE / 1001.0::DOUBLE, 25, 30, 30, 24][1 + k % 5] AS rate FROM g) SELECT k, row_number() OVER (ORDER BY stem::BIGINT)::BIGINT AS place, round(stem::BIGINT / rate, 6) AS sec FROM r WHERE su = '.jpg' AND starts_with(stem, '0')""")
def keyframe_times(spark, sf_dir):
    """Frames in the order of their numbers, and their times at the rate of their video; a rate that is none is 30."""
    from stillwright.operators.ranking import global_rank

    rate = frame_rate(F.element_at(F.array(*[F.lit(r) for r in RATES]), (F.col("k") % len(RATES) + 1).cast("int")))
    found = a.keyframes(files(spark, sf_dir).where("suffix = '.jpg'"), rate)
    return global_rank(found, [F.col("frame_no"), F.col("k")], "place").select("k", (F.col("place") + 1).alias("place"), rounded("sec", 6).alias("sec"))


@query(FILES_SQL + """, n AS (SELECT DISTINCT stem || ext AS name FROM g WHERE bytes > 20 AND k % 2 = 0) SELECT k FROM g WHERE su IN ('.mp4', '.mkv', '.srt', '.ass') AND stem || ext NOT IN (SELECT name FROM n)""")
def files_to_fetch(spark, sf_dir):
    """Files of a listing of the kinds that are fetched, but those that are there with some bytes; an empty one is fetched again."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files(spark, sf_dir).withColumn("name", name)
    present = f.where("k % 2 = 0").select("name", F.when(F.col("bytes") > 20, F.col("bytes")).otherwise(0).alias("bytes"))
    return a.to_fetch(f.select("name", "k"), present).select("k")


@query("""WITH v AS (SELECT o_orderkey AS stem FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT l_orderkey AS stem, min(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END) AS kind FROM lineitem WHERE l_linenumber > 2 AND l_quantity < 10 GROUP BY l_orderkey)
SELECT v.stem, CASE WHEN s.kind IS NULL THEN NULL ELSE v.stem || CASE WHEN s.kind = 0 THEN '.srt' ELSE '.txt' END END AS subtitle FROM v LEFT JOIN s USING (stem)""")
def video_subtitles(spark, sf_dir):
    """Each video with the subtitle of its stem, .srt before .txt."""
    stem = F.col("o_orderkey").cast("string")
    videos = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(stem.alias("stem"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 2 and l_quantity < 10").select(F.col("l_orderkey").cast("string").alias("stem"), F.when(F.col("l_linenumber") % 2 == 0, ".srt").otherwise(".txt").alias("suffix"))
    moments = li.select(F.concat("stem", F.lit(".moments")).alias("stem"), "suffix")
    subtitles = li.unionByName(moments).distinct().withColumn("path", F.concat("stem", "suffix"))
    return a.paired(videos, subtitles).select(F.col("stem").cast("bigint").alias("stem"), "subtitle")


@query("""SELECT page_id, CASE page_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'id_' || page_id || '-x' END AS id, page_id % 4 = 2 AS folder, least(5 * pow(2, page_id % 8), 60)::DOUBLE AS wait FROM pages""")
def shared_links(spark, sf_dir):
    """Ids of shared links of both forms, which links are folders, and the wait after so many failures."""
    k = F.col("page_id").cast("string")
    forms = F.element_at(F.array(F.concat(F.lit("https://host.example/file/d/id_"), k, F.lit("-x/view?usp=s")), F.concat(F.lit("https://host.example/open?x=1&id=id_"), k, F.lit("-x&y=2")), F.concat(F.lit("https://host.example/folders/"), k), F.concat(F.lit("https://host.example/page/"), k)), (F.col("page_id") % 4 + 1).cast("int"))
    links = table(spark, sf_dir, "pages").select("page_id", forms.alias("link"))
    return links.select("page_id", t.shared_id(F.col("link")).alias("id"), t.is_folder_link(F.col("link")).alias("folder"), backoff(F.col("page_id") % 8 + 1).alias("wait"))


@query(f"""WITH e AS (SELECT event_id, event_type, user_id, floor(epoch(ts))::BIGINT % 40000 AS sec FROM events)
SELECT event_id, event_type || '_' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_TriHa' || event_id END || printf('_%dm%02d', sec // 60, sec % 60) || '.jpg' AS dest FROM e""")
def still_names(spark, sf_dir):
    """Names that chosen frames are copied under: role, number, folded label and time."""
    from stillwright.plans.frames import events

    e = events(spark, sf_dir).withColumn("at", F.col("sec") % 40000)
    label = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("Trí hạ"), F.col("event_id").cast("string")))
    return sinks.manifest(e, F.col("event_type"), F.col("user_id"), label, F.col("at")).select("event_id", "dest")


NAMES_SQL = "['chinh_1_' || l_orderkey || '.jpg', 'title_' || l_orderkey || '.txt', 'rieng_' || l_orderkey || '.jpg', 'phu_' || l_orderkey || '.png', 'vat_' || l_orderkey || '.jpg'][1 + (l_linenumber - 1) % 5]"


@query(f"""WITH i AS (SELECT l_suppkey AS f, {NAMES_SQL} AS name, max(l_quantity::BIGINT) AS there FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), p AS (SELECT l_suppkey AS f, {NAMES_SQL} AS name, max(l_quantity::BIGINT) AS b FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber % 5 = 1 GROUP BY ALL),
j AS (SELECT coalesce(p.f, i.f) AS folder, coalesce(p.name, i.name) AS dest, CASE WHEN p.f IS NULL THEN CASE WHEN i.name LIKE '%.jpg' THEN 'delete' END WHEN i.there = p.b THEN 'keep' ELSE 'copy' END AS status FROM p FULL JOIN i ON i.f = p.f AND i.name = p.name)
SELECT folder, dest, status FROM j WHERE status IS NOT NULL""")
def delivery_changes(spark, sf_dir):
    """What a delivery copies, keeps and deletes in folders that hold other people's files as well."""
    key = F.col("l_orderkey").cast("string")
    name = F.element_at(F.array(*[F.concat(F.lit(b), key, F.lit(e)) for b, e in (("chinh_1_", ".jpg"), ("title_", ".txt"), ("rieng_", ".jpg"), ("phu_", ".png"), ("vat_", ".jpg"))]), ((F.col("l_linenumber") - 1) % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("folder"), name.alias("name"), F.col("l_quantity").cast("bigint").alias("bytes"), "l_returnflag", "l_linenumber")
    plan = rows.where("l_returnflag <> 'A' and l_linenumber % 5 = 1").select("folder", F.col("name").alias("dest"), F.lpad(F.col("bytes").cast("string"), 6, "0").alias("src"), "bytes")
    return delivery.changes(plan, rows.where("l_returnflag <> 'N'").select("folder", "name", "bytes")).select("folder", "dest", "status")


GLYPHS = {"a": 0.53, "e": 0.51, "i": 0.27, "o": 0.56, "l": 0.24, "m": 0.87, " ": 0.29}
WIDTH_SQL = "list_sum(list_transform(string_split({0}, ''), lambda c: CASE c " + " ".join(f"WHEN '{g}' THEN {w}::DOUBLE" for g, w in GLYPHS.items()) + " ELSE 0.6::DOUBLE END))"
TITLES = "SELECT p_partkey AS k, replace(p_name, ' ', '  ') || CASE WHEN p_size % 3 = 0 THEN ', ' || p_type ELSE ' ' || p_type END AS title FROM part"


@query(f"""WITH RECURSIVE t AS ({TITLES}), z AS (SELECT k, list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '') AS ws, unnest([30, 28, 26, 24, 22, 20]) AS size FROM t),
f(k, size, ws, i, lines, cur) AS (SELECT k, size, ws, 0, []::VARCHAR[], '' FROM z UNION ALL SELECT k, size, ws, i + 1, CASE WHEN ends THEN [c2] ELSE l2 END, CASE WHEN ends THEN '' ELSE c2 END FROM (
  SELECT *, len(l2) = 0 AND ends_with(c2, ',') AS ends FROM (SELECT *, CASE WHEN fits THEN lines ELSE list_append(lines, cur) END AS l2, CASE WHEN fits THEN longer ELSE ws[i + 1] END AS c2 FROM (
  SELECT *, cur = '' OR size * {WIDTH_SQL.format("longer")} <= 217.3 AS fits FROM (SELECT *, CASE WHEN cur = '' THEN ws[i + 1] ELSE cur || ' ' || ws[i + 1] END AS longer FROM f WHERE i < len(ws)))))),
g AS (SELECT k, size, CASE WHEN cur = '' THEN lines ELSE list_append(lines, cur) END AS lines, floor(size * 1.18::DOUBLE)::BIGINT AS height FROM f WHERE i = len(ws)),
h AS (SELECT *, len(lines) * height <= 90 AND len(list_filter(lines, lambda x: size * {WIDTH_SQL.format("x")} > 217.3)) = 0 AS ok FROM g),
b AS (SELECT * FROM h WHERE ok OR size = 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY size DESC) = 1)
SELECT k, size::BIGINT AS size, array_to_string(lines, '|') AS lines, CASE WHEN ok THEN height ELSE 24 END::BIGINT AS line_height FROM b""")
def title_layout(spark, sf_dir):
    """The largest size at which a title fits its box, the lines it breaks into, and their height."""
    title = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.when(F.col("p_size") % 3 == 0, ", ").otherwise(" "), F.col("p_type"))
    widths = F.create_map(*[F.lit(x) for kv in GLYPHS.items() for x in kv])
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type").repartition("p_partkey")  # a small file is one split, and layout is work
    out = part.select(F.col("p_partkey").alias("k"), layout.fitted(title, widths, F.lit(217.3), F.lit(90), 30).alias("f"))
    return out.select("k", F.col("f.size").cast("bigint").alias("size"), F.array_join("f.lines", "|").alias("lines"), F.col("f.line_height").cast("bigint").alias("line_height"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size * 20 AS h, floor(p_retailprice)::BIGINT AS w, CASE WHEN p_size % 3 = 0 THEN 1280 ELSE 0 END AS width, [4, 2, 1.5][1 + p_size % 3]::DOUBLE AS scale FROM part),
q AS (SELECT *, CASE WHEN width > 0 THEN round_even(h * width::DOUBLE / w, 0) ELSE round_even(h * scale, 0) END::BIGINT AS th, CASE WHEN width > 0 THEN width ELSE round_even(w * scale, 0) END::BIGINT AS tw FROM p)
SELECT k, CASE WHEN (width > 0 OR scale <> 4) AND NOT (th = h * 4 AND tw = w * 4) THEN th END AS h, CASE WHEN (width > 0 OR scale <> 4) AND NOT (th = h * 4 AND tw = w * 4) THEN tw END AS w FROM q""")
def enlarged_sizes(spark, sf_dir):
    """What size an enlarged image is brought to, by width or by scale; none where nothing changes."""
    c = F.col
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), (c("p_size") * 20).cast("double").alias("h"), F.floor("p_retailprice").cast("double").alias("w"), F.when(c("p_size") % 3 == 0, 1280).otherwise(0).alias("width"), F.element_at(F.array(F.lit(4.0), F.lit(2.0), F.lit(1.5)), (c("p_size") % 3 + 1).cast("int")).alias("scale"))
    size = layout.target_size(c("h"), c("w"), c("width"), c("scale"))
    return p.select("k", size.alias("s")).select("k", F.col("s.h").cast("bigint").alias("h"), F.col("s.w").cast("bigint").alias("w"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round_even((floor(l_extendedprice)::BIGINT % 256) * ((l_partkey % 256) / 255.0::DOUBLE) + 255.0::DOUBLE * (1 - (l_partkey % 256) / 255.0::DOUBLE), 0)::BIGINT AS value FROM lineitem")
def blended_on_white(spark, sf_dir):
    """Channel values over white by their alpha."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), layout.on_white(F.floor("l_extendedprice") % 256, F.col("l_partkey") % 256).cast("bigint").alias("value"))


@query("""WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding AS e FROM embeddings), n AS (SELECT vec_id, e[i + 1]::DOUBLE AS x, e[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1]::DOUBLE + e[CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END + 1]::DOUBLE + e[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1]::DOUBLE + e[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1]::DOUBLE AS around FROM c)
SELECT vec_id, round(var_pop(around - 4 * x), 6) AS sharpness FROM n GROUP BY vec_id""")
def crop_sharpness(spark, sf_dir):
    """Variance of the Laplacian of vectors as crops of 8 x 8 cells."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("embedding", y * 8 + 1, 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(layout.sharpness(rows), 6).alias("sharpness"))


@query("""WITH p AS (SELECT vec_id, list_transform(range(0, CASE WHEN vec_id % 5 = 0 THEN 60 ELSE 72 END), lambda i: embedding[i % 64 + 1]::DOUBLE) AS ys, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 2.5::DOUBLE END AS w FROM embeddings)
SELECT vec_id, CASE WHEN len(ys) < 72 OR w <= 0 THEN 1 ELSE round((list_max(ys[65:72]) - list_min(ys[65:72])) / w, 9) END::DOUBLE AS lip_gap, CASE WHEN len(ys) < 64 OR w <= 0 THEN 0.5 ELSE round((list_max(ys[53:64]) - list_min(ys[53:64])) / w, 9) END::DOUBLE AS mouth FROM p""")
def landmark_ratios(spark, sf_dir):
    """Inner lip height and outer lip height over the mouth's width, of landmarks; defaults without landmarks or width."""
    n = F.when(F.col("vec_id") % 5 == 0, 59).otherwise(71)
    points = F.transform(F.sequence(F.lit(0), n), lambda i: F.array(i.cast("double"), F.get("embedding", i % 64).cast("double")))
    p = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("p"), F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(2.5).alias("w"))
    return p.select("vec_id", rounded(vectors.lip_gap(F.col("p"), F.col("w")), 9).alias("lip_gap"), rounded(vectors.mouth_open(F.col("p"), F.col("w")), 9).alias("mouth"))


@query("""WITH s AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT user_id, CASE WHEN list_contains(a, 'signup') THEN 'signup' WHEN list_contains(a, 'error') THEN 'error' WHEN list_contains(a, 'view') THEN 'view' END AS first FROM s""")
def first_choice(spark, sf_dir):
    """The first of a list of preferences that each user has."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return e.select("user_id", t.first_available(["signup", "error", "view"], F.col("a")).alias("first"))


@query("SELECT 0 AS scan, s_suppkey AS k FROM supplier UNION ALL SELECT 1, c_custkey FROM customer UNION ALL SELECT 2, n_nationkey FROM nation")
def scans_in_sequence(spark, sf_dir):
    """The rows of three scans, numbered by scan."""
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("k"))
    return a.in_sequence(of("supplier", "s_suppkey"), of("customer", "c_custkey"), of("nation", "n_nationkey")).select("scan", "k")


@query("SELECT doc_id, minutes || 'm' || lpad((sec % 60)::VARCHAR, 2, '0') AS mark FROM (SELECT doc_id, n_chars AS sec, n_chars // 60 AS minutes FROM documents)")
def minute_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", minutes_mark(F.col("n_chars")).alias("mark"))


@query("SELECT o_orderkey % 7 AS part, o_orderkey, o_custkey + CASE WHEN o_orderkey % 7 IN (2, 5) THEN 1000000 ELSE 0 END AS v FROM orders WHERE o_orderkey % 7 <> 5 OR o_orderkey % 2 = 0")
def cache_round_trip(spark, sf_dir):
    """A cache that is written by partition, two partitions of it anew, and read back."""
    path = sinks.scratch(spark, "cache")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("part"), "o_orderkey", F.col("o_custkey").alias("v"))
    sinks.write_cache(rows, path, "part")
    sinks.write_cache(rows.where("part = 2 or part = 5 and o_orderkey % 2 = 0").withColumn("v", F.col("v") + 1000000), path, "part")
    return sinks.read_cache(spark, path, "o_orderkey bigint, v bigint, part bigint").select("part", "o_orderkey", "v")


@query("SELECT n_nationkey AS k, n_nationkey % 3 = 0 AS again, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS scans FROM nation")
def scanned_once(spark, sf_dir):
    """Files that are scanned, then again only where their size has changed; the record is written after a scan."""
    cache, records = sinks.scratch(spark, "scans"), sinks.scratch(spark, "records")
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("stem"), F.lit("p").alias("path"))
    done = []
    for k in range(3):  # the third time nothing is left to do
        now = named.withColumn("bytes", F.when(F.lit(k > 0) & (F.col("n_nationkey") % 3 == 0), 11).otherwise(10).cast("bigint"))
        done.append(sinks.scan_changed(now, lambda todo: todo.select("stem", F.col("bytes").alias("found")), cache, records).select("stem"))
    counts = a.in_sequence(*done).groupBy("stem").agg(F.count(F.lit(1)).cast("int").alias("scans"))
    return named.join(counts, "stem").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3 == 0).alias("again"), "scans")


@query("SELECT 'nation_' || n_nationkey AS doc, n_name || chr(10) || 'second ' || n_regionkey AS text FROM nation")
def written_texts(spark, sf_dir):
    """Texts that are written by key and read back as whole files."""
    path = sinks.scratch(spark, "texts")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("key"), F.concat("n_name", F.lit("\nsecond "), F.col("n_regionkey").cast("string")).alias("text"))
    sinks.write_texts(n, path, "key", "text")
    rows = spark.read.text(path, wholetext=True).select("key", "value")
    return rows.select(F.col("key").alias("doc"), F.regexp_replace("value", r"\n$", "").alias("text"))
