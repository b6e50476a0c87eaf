"""Queries on texts, files and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwright.functions import text as t
from stillwright.functions.numbers import rounded
from stillwright.operators.matching import by_prefix, preferred
from stillwright.plans.registry import query, table
from stillwright.sources.annotations import changed, queue


@query("""WITH r AS (SELECT source, doc_id AS best, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS n FROM documents JOIN labels USING (doc_id))
SELECT d.doc_id, r.best FROM documents d LEFT JOIN r ON r.source = d.source AND r.n = 1""")
def pair_left_precedence(spark, sf_dir):
    """Every document with the preferred labelled one of its source; the right side is one row a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("doc_id").alias("best"), "quality")
    return preferred(docs, labelled, "source", [F.desc("quality"), F.col("best")]).select("doc_id", "best")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages)")
def ready_set(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_sub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("""SELECT page_id, CASE WHEN url LIKE '%.srt' OR url LIKE '%.ass' OR url LIKE '%.vtt' THEN 0 ELSE 1 END::BIGINT AS priority FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def queue_order_anti(spark, sf_dir):
    present = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return queue(table(spark, sf_dir, "pages"), present, "page_id", "page_id", F.col("url")).select("page_id", F.col("priority").cast("bigint").alias("priority"))


PREFIXES = [("ec", "thrift"), ("pr", "offer"), ("l", "big"), ("sm", "tiny"), ("sma", "very tiny")]


@query("""WITH p(prefix, value) AS (VALUES ('ec', 'thrift'), ('pr', 'offer'), ('l', 'big'), ('sm', 'tiny'), ('sma', 'very tiny')),
j AS (SELECT p_partkey, o.value AS own, x.value AS value, row_number() OVER (PARTITION BY p_partkey ORDER BY length(x.prefix) DESC NULLS LAST) AS r FROM part LEFT JOIN p o ON o.prefix = CASE WHEN p_size = 1 THEN 'pr' WHEN p_size = 2 THEN 'zz' END LEFT JOIN p x ON starts_with(lower(p_type), x.prefix))
SELECT p_partkey, coalesce(own, value, 'default') AS value FROM j WHERE r = 1""")
def prefix_lookup(spark, sf_dir):
    """An override if it is known, else the longest prefix, else the default."""
    parts = table(spark, sf_dir, "part").withColumn("override", F.when(F.col("p_size") == 1, "pr").when(F.col("p_size") == 2, "zz"))
    return by_prefix(parts, spark.createDataFrame(PREFIXES, "prefix string, value string"), "p_type", F.col("override"), "default").select("p_partkey", "value")


LINES_SQL = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(LINES_SQL + """, b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
SELECT doc_id, pos::BIGINT AS pos, line FROM b WHERE line IS DISTINCT FROM before""")
def dialogue_dedup(spark, sf_dir):
    return changed(document_lines(spark, sf_dir), "doc_id", "pos", "line").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def dialogue_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("dialogue"), "n")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS x, regexp_extract(url, '/([^/?#]*)[^/]*$', 1) AS id FROM pages)
SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&')), '') AS name, id FROM p""")
def html_title_name(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", t.page_title(F.col("html")).alias("name"), F.regexp_extract("url", r"/([^/?#]*)[^/]*$", 1).alias("id"))


FIRST_SQL = "WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)"


def first_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("line"))


NOISE_SQL = r"""'(?i)^\s*(?:\[[^\]]*\]\s*$|```|#{1,6}\s|(?:CHỌN|Vì sao|Rủi ro|Á quân)\s*:)'"""
TITLES_SQL = FIRST_SQL + r""", c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(line, '^\s*(?:\d+[.)]|[-*•👉])\s*', ''), '\s*[(\[]\s*\d+\s*[)\]]\s*$', '')) AS title FROM f WHERE NOT regexp_matches(line, """ + NOISE_SQL + """)),
d AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS r FROM c WHERE title <> ''),
l AS (SELECT doc_id, title, length(title)::BIGINT AS n, CASE WHEN length(title) > 100 THEN 'too_long' WHEN length(title) > 70 THEN 'cut' WHEN length(title) > 60 THEN 'long' ELSE 'ok' END AS class, CASE WHEN length(title) > 50 THEN substr(title, 1, 50) || '...' ELSE title END AS preview FROM d WHERE r = 1)"""


@query(TITLES_SQL + " SELECT * FROM l")
def title_lint(spark, sf_dir):
    """First lines without noise and repeats, classed by length."""
    rows = first_lines(spark, sf_dir).where(~t.is_noise(F.col("line"))).select("doc_id", t.clean_title(F.col("line")).alias("title")).where("title <> ''")
    kept = rows.groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    x = F.col("title")
    return kept.select("doc_id", "title", F.length(x).cast("bigint").alias("n"), t.length_class(x).alias("class"), t.preview(x).alias("preview"))


@query(TITLES_SQL + " SELECT count(*)::BIGINT AS titles, count(*) FILTER (class = 'ok')::BIGINT AS good, count(*) FILTER (class = 'too_long')::BIGINT AS too_long FROM l")
def title_report(spark, sf_dir):
    """The counts below the list of titles."""
    return title_lint(spark, sf_dir).agg(F.count(F.lit(1)).alias("titles"), F.count_if(F.col("class") == "ok").alias("good"), F.count_if(F.col("class") == "too_long").alias("too_long"))


@query(FIRST_SQL + r""", w AS (SELECT doc_id, line, length(line) AS chars, len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) AS words, length(line) - length(replace(line, ',', '')) AS commas, length(trim(string_split(line, ',')[1])) AS clause FROM f)
SELECT doc_id, chars::BIGINT AS chars, words::BIGINT AS words, commas::BIGINT AS commas, clause::BIGINT AS first_clause, array_to_string(list_filter([CASE WHEN chars NOT BETWEEN 91 AND 100 THEN 'length' END, CASE WHEN words NOT BETWEEN 21 AND 25 THEN 'words' END, CASE WHEN commas <> 1 THEN 'commas' END, CASE WHEN clause NOT BETWEEN 30 AND 45 THEN 'clause' END,
CASE WHEN NOT regexp_matches(line, '(?i)^[^,]*,\s*(?:Nào Ngờ|Ai Ngờ|Không Ngờ)') THEN 'turn' END, CASE WHEN NOT regexp_matches(line, '(?i)Khiến') THEN 'consequence' END, CASE WHEN regexp_matches(line, '(?i)Và Cái Kết') THEN 'banned' END], lambda x: x IS NOT NULL), ',') AS faults FROM w""")
def title_shape(spark, sf_dir):
    """Measures of first lines, and what they lack of the shape of a title."""
    x = F.col("line")
    clause = F.length(t.trimmed(F.split(x, ",")[0])).cast("bigint")
    return first_lines(spark, sf_dir).select("doc_id", F.length(x).cast("bigint").alias("chars"), t.word_count(x).cast("bigint").alias("words"), F.regexp_count(x, F.lit(",")).cast("bigint").alias("commas"), clause.alias("first_clause"), F.array_join(t.title_faults(x), ",").alias("faults"))


@query("SELECT source, count(*)::BIGINT AS n, count(*) FILTER (contains(text, 'the'))::BIGINT AS k_the, count(*) FILTER (contains(text, 'License'))::BIGINT AS k_license, round(count(*) FILTER (contains(text, '@')) / count(*), 6) AS share_mail FROM documents GROUP BY source")
def keyword_share(spark, sf_dir):
    x = F.col("text")
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("n"), F.count_if(x.contains("the")).alias("k_the"), F.count_if(x.contains("License")).alias("k_license"), rounded(F.count_if(x.contains("@")) / n, 6).alias("share_mail"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS role, CASE WHEN event_id % 5 <> 0 THEN user_id END::BIGINT AS number, CASE WHEN event_id % 5 <> 0 THEN 'n_' || event_id END AS label FROM events""")
def file_name_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit(".jpg"))).otherwise(F.concat("event_type", F.lit("_"), "user_id", F.lit("_n_"), "event_id", F.lit(".jpg")))
    return e.select("event_id", t.role_file_name(F.concat(F.lit("out/"), name)).alias("p")).select("event_id", "p.role", F.col("p.number").cast("bigint").alias("number"), "p.label")


@query(FIRST_SQL + """ SELECT doc_id, replace(replace(replace('{LANG}: {LINE} / {SOURCE}', '{LANG}', lang), '{LINE}', CASE WHEN doc_id % 10 = 0 THEN 'see {SOURCE}' ELSE line END), '{SOURCE}', source) AS prompt FROM f JOIN documents USING (doc_id)""")
def template_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("line", F.when(F.col("doc_id") % 10 == 0, "see {SOURCE}").otherwise(F.split("text", "\n")[0]))
    return d.select("doc_id", t.filled(F.lit("{LANG}: {LINE} / {SOURCE}"), [("{LANG}", F.col("lang")), ("{LINE}", F.col("line")), ("{SOURCE}", F.col("source"))]).alias("prompt"))


@query(FIRST_SQL + r""" SELECT doc_id, source, trim(line) AS example FROM f JOIN documents USING (doc_id) WHERE source <> 'src1' AND NOT regexp_matches(line, '^\s*#') AND trim(line) <> ''""")
def few_shot(spark, sf_dir):
    """Approved lines of all other works."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n")[0].alias("line"))
    return d.where((F.col("source") != "src1") & ~F.col("line").rlike(r"^\s*#") & (t.trimmed(F.col("line")) != "")).select("doc_id", "source", t.trimmed(F.col("line")).alias("example"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN '- `canh_chung_' || user_id || '.jpg` — ảnh chung, chỉ để tham khảo cách họ đứng cạnh nhau và tỉ lệ to nhỏ giữa các nhân vật'
WHEN event_type = 'click' THEN '- `chinh_' || user_id % 3 || '_' || CASE WHEN event_id % 2 = 0 THEN 'A' ELSE '' END || '_9m01.jpg` — NHÂN VẬT CHÍNH ' || user_id % 3 || CASE WHEN event_id % 2 = 0 THEN ', tên trong phim: A' ELSE '' END || CASE WHEN user_id % 3 = 1 THEN '  **<- cả phim xoay quanh người này, bắt buộc có trong khung**' ELSE '' END
WHEN event_type = 'purchase' THEN '- `vat_' || user_id || '_Ho_1m00.jpg` — con vật / vật thể trung tâm ' || user_id || ': Ho. Giữ đúng loài, màu, cỡ như trong ảnh' END AS line FROM events""")
def image_list(spark, sf_dir):
    """Lines of the list of reference images, from file names."""
    c = F.col
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    user, mod = c("user_id").cast("string"), (c("user_id") % 3).cast("string")
    name = F.when(c("event_type") == "view", text("canh_chung_", user, ".jpg")).when(c("event_type") == "click", text("chinh_", mod, "_", F.when(c("event_id") % 2 == 0, "A").otherwise(""), "_9m01.jpg"))
    name = name.when(c("event_type") == "purchase", text("vat_", user, "_Ho_1m00.jpg")).otherwise("chinh_1.jpg")
    return table(spark, sf_dir, "events").select("event_id", t.listed_image(text("out/", name)).alias("line"))
