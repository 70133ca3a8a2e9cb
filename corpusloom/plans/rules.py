"""Queries of the catalogue's filters, projections, remaining joins, counts, orders and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import records
from corpusloom.plans.registry import registry
from corpusloom.sources.tables import table

QUERIES, SQL, query = registry()

# ---- captures: events play the part of a capture log

_CAPTURES = """(SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN '404' ELSE '200' END AS status, (value * 100)::INTEGER AS length, CASE event_id % 7 WHEN 0 THEN 'http://home.example/novel/' || user_id || '.html'
  WHEN 1 THEN 'http://home.example//x/' || user_id WHEN 2 THEN 'http://home.example/a/http:/b' WHEN 3 THEN 'http://home.example/robots.txt' WHEN 4 THEN 'http://other.example/p' || user_id || '.html'
  WHEN 5 THEN 'http://www.home.example/novel/' || event_id || '.txt' ELSE 'http://home.example/img/Pic_' || event_id || '.GIF' END AS url FROM events)"""


def _captures(spark: SparkSession, d: str) -> DataFrame:
    k, user, no = F.col("event_id") % 7, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("http://home.example/novel/"), user, F.lit(".html"))).when(k == 1, F.concat(F.lit("http://home.example//x/"), user)).when(k == 2, "http://home.example/a/http:/b")
        .when(k == 3, "http://home.example/robots.txt").when(k == 4, F.concat(F.lit("http://other.example/p"), user, F.lit(".html"))).when(k == 5, F.concat(F.lit("http://www.home.example/novel/"), no, F.lit(".txt")))
        .otherwise(F.concat(F.lit("http://home.example/img/Pic_"), no, F.lit(".GIF")))
    )
    status = F.when(F.col("event_type") == "error", "404").otherwise("200")
    return table(spark, d, "events").select("event_id", "user_id", "ts", status.alias("status"), F.round(F.col("value") * 100).cast("int").alias("length"), url.alias("url"))


@query(f"SELECT event_id, url FROM {_CAPTURES} WHERE status = '200'")
def fil01_status_ok(spark: SparkSession, d: str) -> DataFrame:
    """Captures that succeeded."""
    return _captures(spark, d).where("status = '200'").select("event_id", "url")


@query(f"""
SELECT event_id, regexp_replace(regexp_replace(url, '^http://', ''), '^(www\\d*\\.)?home\\.example/', '') AS path FROM {_CAPTURES}
WHERE regexp_matches(url, '^http://(www\\d*\\.)?home\\.example/[^/]') AND NOT contains(url, '/http:/') AND NOT ends_with(url, 'robots.txt')
""")
def fil02_mappable(spark: SparkSession, d: str) -> DataFrame:
    """Captures with a path in the tree: known host, no nested, rootless or machine's address."""
    own = r"^https?://(?:www\d*\.)?home\.example/+"
    c = _captures(spark, d).where(F.col("url").rlike(own) & ~urls.malformed(F.col("url")))
    return c.select("event_id", F.regexp_replace("url", own, "").alias("path"))


@query(f"SELECT event_id, t || '/x' AS target FROM (SELECT event_id, url || unnest(['', '<b>', '?q', '$x']) AS t, unnest([1, 2, 3, 4]) AS n FROM {_CAPTURES}) WHERE n IN (1, 3) AND contains(t, 'other') = false AND NOT contains(substr(t, 8), '//')")
def fil03_internal_unjunked(spark: SparkSession, d: str) -> DataFrame:
    """Targets that can be files of the own host."""
    c = _captures(spark, d).select("event_id", F.explode(F.array(*[F.concat("url", F.lit(x)) for x in ("", "<b>", "?q", "$x")])).alias("t"))
    return c.where(~urls.is_junk(F.regexp_replace("t", "^http://", "")) & ~F.col("t").contains("other")).select("event_id", F.concat("t", F.lit("/x")).alias("target"))


@query("""
SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'adsbygoogle' ELSE text END AS page FROM documents WHERE text IS NOT NULL) WHERE NOT (length(page) > 100 AND length(page) < 400 AND contains(page, 'adsbygoogle'))
""")
def fil06_no_soft_404(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are no error page of the right size with the mark of one."""
    from corpusloom.sources.files import soft_404

    page = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("adsbygoogle"))).otherwise(F.col("text"))
    return table(spark, d, "documents").where("text is not null").where(~soft_404(page, 100, 400)).select("doc_id")


@query("""
SELECT DISTINCT source_path FROM episodes WHERE starts_with(source_path, 'novel/') AND regexp_matches(source_path, '\\.(html?|txt)$') AND length(regexp_extract(source_path, '([^/]*)$', 1)) > 8
  AND lower(regexp_extract(source_path, '([^/]*)$', 1)) NOT IN ('index.html', 'index.htm', 'top.html', 'menu.html', 'main.html')
""")
def fil09_lost_work_targets(spark: SparkSession, d: str) -> DataFrame:
    """Paths that can be lost works: pages or texts of novels whose name is long enough and none of every site's."""
    p = F.col("source_path")
    name = urls.basename(p)
    common = ["index.html", "index.htm", "top.html", "menu.html", "main.html"]
    return table(spark, d, "episodes").where(p.startswith("novel/") & p.rlike(r"\.(?:html?|txt)$") & (F.length(name) > 8) & ~F.lower(name).isin(common)).select("source_path").distinct()


@query("SELECT corpus, count(*) AS n, count(*) FILTER (entry_role = 'work') AS works FROM episodes WHERE corpus IN ('honkan', 'legacy', 'uncatalogued') GROUP BY corpus")
def fil10_corpora(spark: SparkSession, d: str) -> DataFrame:
    """The named corpora."""
    return table(spark, d, "episodes").where(F.col("corpus").isin("honkan", "legacy", "uncatalogued")).groupBy("corpus").agg(F.count("*").alias("n"), F.count_if(F.col("entry_role") == "work").alias("works"))


@query("""
WITH c AS (SELECT md5(text) AS h, min(episode_id) AS alias FROM documents WHERE text IS NOT NULL AND kind = 'body' AND episode_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN c.h IS NOT NULL AND d.kind <> 'body' THEN 'duplicate-of-catalogued' WHEN starts_with(d.source, 'board') THEN 'cgi-view' WHEN d.kind = 'notice' THEN 'site-template'
  WHEN coalesce(length(regexp_replace(regexp_replace(d.text, '<[^>]+>', '', 'g'), '[\\s　]+', '', 'g')), 0) = 0 THEN 'empty' END AS reason, CASE WHEN c.h IS NOT NULL AND d.kind <> 'body' THEN c.alias END AS alias
FROM documents d LEFT JOIN c ON md5(d.text) = c.h
""")
def fil11_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Why a file stays out of the catalogue, by the first reason that holds, or null."""
    docs = table(spark, d, "documents").withColumn("h", F.md5("text"))
    c = docs.where("text is not null and kind = 'body' and episode_id is not null").groupBy("h").agg(F.min("episode_id").alias("_alias"))
    chars = F.coalesce(F.length(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", ""), r"[\s　]+", "")), F.lit(0))
    r = records.exclusion(F.col("_alias").isNotNull() & (F.col("kind") != "body"), F.col("source").startswith("board"), F.col("kind") == "notice", F.lit(False), (chars == 0))
    return docs.join(c, "h", "left").select("doc_id", r.alias("reason"), F.when(r == "duplicate-of-catalogued", F.col("_alias")).alias("alias"))


@query("SELECT entry_no, (title IS NULL OR title = '') AS no_title, (genre_raw IS NULL OR len(genre_raw) = 0) AS no_genre FROM episodes")
def fil12_missing(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold nothing: null, an empty string or an empty list."""
    return table(spark, d, "episodes").select("entry_no", records.missing(F.col("title"), "string").alias("no_title"), records.missing(F.col("genre_raw"), "array").alias("no_genre"))


@query("SELECT entry_no, episode_id FROM (SELECT * FROM episodes ORDER BY entry_no LIMIT 25) UNION SELECT entry_no, episode_id FROM episodes WHERE episode_id = (SELECT min(episode_id) FROM episodes)")
def fil13_first_or_one(spark: SparkSession, d: str) -> DataFrame:
    """The first lines in order, and the lines of one id."""
    e = table(spark, d, "episodes").select("entry_no", "episode_id")
    one = e.agg(F.min("episode_id").alias("episode_id"))
    return e.orderBy("entry_no").limit(25).unionByName(e.join(F.broadcast(one), "episode_id", "left_semi").select("entry_no", "episode_id")).distinct()


@query("""
SELECT d.doc_id FROM documents d JOIN (SELECT DISTINCT episode_id, source_path FROM episodes) e USING (episode_id) WHERE d.kind = 'body' AND d.text IS NOT NULL AND d.text <> '' AND regexp_matches(lower(e.source_path), '\\.html?$') AND NOT regexp_matches(e.source_path, '^[a-z]+://')
GROUP BY d.doc_id
""")
def fil14_verification_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Bodies to be checked again: converted from local pages, not from texts or addresses."""
    e = table(spark, d, "episodes").where(F.lower("source_path").rlike(r"\.html?$") & ~F.col("source_path").rlike("^[a-z]+://")).select("episode_id")
    return table(spark, d, "documents").where("kind = 'body' and text is not null and text <> ''").join(e, "episode_id", "left_semi").select("doc_id").distinct()


_W, _N = text.WIDE.replace("'", "''"), text.THIN.replace("'", "''")
_CORE = f"""(SELECT work_slug, evidence, ord, eid, title, CASE WHEN c <> '' THEN c ELSE title END AS core FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(translate(title, '{_W}', '{_N}'), ' '),
  '[\\s　]*[（(][0-9０-９]+[)）]$', ''), '[\\s　]*第[0-9０-９一二三四五六七八九十百]+[話回章部夜]$', ''), '[\\s　]*その[0-9０-９一二三四五六七八九十]+$', ''),
  '(?i)[\\s　]*(?:lesson|episode|stage|no\\.?|vol\\.?|act|part)[\\s　]*[0-9０-９]+$', ''), '[\\s　]+[0-9０-９一二三四五六七八九十]+$', '') AS c
  FROM (SELECT DISTINCT work_slug, evidence, x.ordinal AS ord, x.episode_id AS eid, x.title AS title FROM (SELECT work_slug, evidence, unnest(episodes) AS x FROM works))))"""
_WEAK = ["filename-stem", "title-prefix", "title", "directory"]


def _cores(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").select("work_slug", "evidence", F.explode("episodes").alias("x")).select("work_slug", "evidence", F.col("x.ordinal").alias("ord"), F.col("x.episode_id").alias("eid"), F.col("x.title").alias("title")).distinct()
    return w.withColumn("core", text.title_core(F.col("title")))


@query(f"""
SELECT work_slug, len(list_filter(any_value(evidence), lambda x: x NOT IN ('filename-stem', 'title-prefix', 'title', 'directory'))) = 0 AS weak FROM {_CORE} WHERE core IS NOT NULL GROUP BY work_slug
HAVING count(*) >= 2 AND count(DISTINCT core) >= 2 AND count(DISTINCT left(core, 2)) > 1
""")
def fil15_review_targets(spark: SparkSession, d: str) -> DataFrame:
    """Works to look at: several members, several title cores, no shared beginning."""
    g = _cores(spark, d).where("core is not null").groupBy("work_slug").agg(F.count("*").alias("n"), F.count_distinct("core").alias("c"), F.count_distinct(F.substring("core", 1, 2)).alias("s"), F.first("evidence", ignorenulls=True).alias("ev"))
    weak = F.array(*[F.lit(x) for x in _WEAK])
    return g.where("n >= 2 and c >= 2 and s > 1").select("work_slug", F.when(F.col("ev").isNotNull(), F.size(F.array_except("ev", weak)) == 0).alias("weak"))


@query("SELECT kansou_slug, count(*) AS n FROM episodes WHERE withdrawn_at IS NULL AND entry_role = 'work' GROUP BY kansou_slug")
def fil16_published(spark: SparkSession, d: str) -> DataFrame:
    """Lines that count: published works, by board."""
    return table(spark, d, "episodes").where("withdrawn_at is null and entry_role = 'work'").groupBy("kansou_slug").agg(F.count("*").alias("n"))


@query("SELECT taxonomy, count(DISTINCT slug) AS n FROM vocabulary WHERE taxonomy IN ('ts_genre', 'ts_type', 'ts_keyword') GROUP BY taxonomy")
def fil19_searchable(spark: SparkSession, d: str) -> DataFrame:
    """The taxonomies that can be searched."""
    return table(spark, d, "vocabulary").where(F.col("taxonomy").isin("ts_genre", "ts_type", "ts_keyword")).groupBy("taxonomy").agg(F.count_distinct("slug").alias("n"))


@query("SELECT term_no, r FROM (SELECT term_no, unnest(list_append(raw_variants, '（？）')) AS r FROM terms) WHERE r IS NOT NULL AND NOT regexp_matches(r, '^[?？()（）\\s　]+$')")
def fil20_specified(spark: SparkSession, d: str) -> DataFrame:
    """Typed terms that say something."""
    t = table(spark, d, "terms").select("term_no", F.explode(F.array_append("raw_variants", F.lit("（？）"))).alias("r"))
    return t.where(F.col("r").isNotNull() & ~text.is_unspecified(F.col("r")))


_FIELDS = {"title": "post_title", "author": "ts_author", "kansou_slug": "ts_board", "date_raw": "ts_date_raw", "catalog_ref": "ts_ref", "route": "ts_route"}


@query(" UNION ALL ".join(f"SELECT entry_no, '{new}' AS field, {old} AS value FROM episodes WHERE {old} IS NOT NULL AND {old} <> ''" for old, new in _FIELDS.items()) + " UNION ALL SELECT entry_no, 'ts_genre', array_to_string(genre_raw, ' ') FROM episodes WHERE len(genre_raw) > 0")
def prj01_storage_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines as stored fields under their names there; empty ones are left out."""
    pairs = [F.struct(F.lit(new).alias("field"), F.when(F.col(old) != "", F.col(old)).alias("value")) for old, new in _FIELDS.items()]
    pairs.append(F.struct(F.lit("ts_genre").alias("field"), F.when(F.size("genre_raw") > 0, F.array_join("genre_raw", " ")).alias("value")))
    return table(spark, d, "episodes").select("entry_no", F.explode(F.array(*pairs)).alias("p")).where("p.value is not null").select("entry_no", "p.field", "p.value")


@query("""
WITH b AS (SELECT episode_id, min(doc_id) AS doc FROM documents WHERE kind = 'body' AND text IS NOT NULL AND text <> '' GROUP BY 1)
SELECT e.entry_no, CASE WHEN e.withdrawn_at IS NOT NULL THEN 'empty' WHEN e.entry_role = 'notice' THEN 'no-touch' WHEN b.doc IS NOT NULL THEN 'payload' ELSE 'placeholder' END AS choice, CASE WHEN e.withdrawn_at IS NULL AND e.entry_role IS DISTINCT FROM 'notice' THEN b.doc END AS doc
FROM episodes e LEFT JOIN b USING (episode_id)
""")
def prj02_body_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which body a line gets: none after withdrawal, the one it has, a payload or a placeholder."""
    b = table(spark, d, "documents").where("kind = 'body' and text is not null and text <> ''").groupBy("episode_id").agg(F.min("doc_id").alias("_doc"))
    gone, kept = F.col("withdrawn_at").isNotNull(), F.coalesce(F.col("entry_role") == "notice", F.lit(False))
    choice = F.when(gone, "empty").when(kept, "no-touch").when(F.col("_doc").isNotNull(), "payload").otherwise("placeholder")
    return table(spark, d, "episodes").join(b, "episode_id", "left").select("entry_no", choice.alias("choice"), F.when(~gone & ~kept, F.col("_doc")).alias("doc"))


@query("SELECT entry_no, title FROM episodes")
def prj03_public_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines without private columns."""
    return records.public(table(spark, d, "episodes").select("entry_no", F.col("size_kb").alias("_kb"), "title", F.col("author").alias("_author")))


@query("""
SELECT entry_no, CASE WHEN regexp_matches(source_path, '(?i)\\.(gif|jpe?g|png|bmp)$') THEN 'image' WHEN regexp_matches(source_path, '^[a-z]+://') THEN 'external' ELSE 'html' END AS type FROM episodes
""")
def prj04_entry_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of lines by suffix and place."""
    kind = F.when(F.col("source_path").rlike("^[a-z]+://"), "external").otherwise("local")
    return table(spark, d, "episodes").select("entry_no", urls.entry_type(F.col("source_path"), kind).alias("type"))


@query("""
WITH m AS (SELECT dir, author FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, author) AS rn FROM (SELECT regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS dir, author, count(*) AS n FROM episodes WHERE author IS NOT NULL AND source_path IS NOT NULL GROUP BY ALL)) WHERE rn = 1)
SELECT e.entry_no, coalesce(e.title, regexp_replace(regexp_extract(e.source_path, '([^/]*)$', 1), '\\.[a-z]+$', '')) AS title, coalesce(e.author, m.author) AS author,
  array_to_string(list_filter([CASE WHEN e.title IS NOT NULL THEN 'lib-index' WHEN e.source_path IS NOT NULL THEN 'filename' END, CASE WHEN e.author IS NOT NULL THEN 'lib-index' WHEN m.author IS NOT NULL THEN 'dir-author' END], lambda x: x IS NOT NULL), ',') AS sources
FROM episodes e LEFT JOIN m ON regexp_extract(e.source_path, '^(.*)/[^/]*$', 1) = m.dir
""")
def prj05_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Title and author of each line from the first source that has them, with the sources."""
    e = table(spark, d, "episodes").select("entry_no", "title", "author", "source_path", urls.dirname(F.col("source_path")).alias("dir"))
    n = e.where("author is not null and source_path is not null").groupBy("dir", "author").agg(F.count("*").alias("n"))
    m = n.groupBy("dir").agg(F.min(F.struct(-F.col("n"), "author"))["author"].alias("_a"))
    stem = F.regexp_replace(urls.basename(F.col("source_path")), r"\.[a-z]+$", "")
    sources = F.array_compact(F.array(F.when(F.col("title").isNotNull(), "lib-index").when(F.col("source_path").isNotNull(), "filename"), F.when(F.col("author").isNotNull(), "lib-index").when(F.col("_a").isNotNull(), "dir-author")))
    return e.join(m, "dir", "left").select("entry_no", F.coalesce("title", stem).alias("title"), F.coalesce("author", "_a").alias("author"), F.array_join(sources, ",").alias("sources"))


# ---- joins


@query("SELECT entry_no FROM episodes l WHERE corpus = 'legacy' AND source_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM episodes r WHERE r.corpus IS DISTINCT FROM 'legacy' AND r.source_path = l.source_path)")
def join04_legacy_only(spark: SparkSession, d: str) -> DataFrame:
    """Legacy lines whose exact path no other corpus has."""
    e = table(spark, d, "episodes").where("source_path is not null").select("entry_no", "corpus", "source_path")
    return e.where("corpus = 'legacy'").join(e.where("not corpus <=> 'legacy'").select("source_path"), "source_path", "left_anti").select("entry_no")


@query("""
WITH c AS (SELECT md5(text) AS h, min(episode_id) AS alias FROM documents WHERE kind = 'body' AND episode_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT d.doc_id, c.alias AS alias_of FROM documents d JOIN c ON md5(d.text) = c.h WHERE d.kind IS DISTINCT FROM 'body'
""")
def join05_duplicates_of_catalogued(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the bytes of a catalogued body."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "kind", "episode_id", F.md5("text").alias("h"))
    c = t.where("kind = 'body' and episode_id is not null").groupBy("h").agg(F.min("episode_id").alias("alias_of"))
    return t.where("not kind <=> 'body'").join(c, "h").select("doc_id", "alias_of")


@query(f"""
WITH m AS (SELECT DISTINCT lower(regexp_extract(replace(x.episode_id, '__', '/'), '([^/]*)$', 1)) AS bn, x.episode_id AS target FROM (SELECT unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL AND x.episode_id NOT IN (SELECT episode_id FROM episodes WHERE episode_id IS NOT NULL)),
c AS (SELECT DISTINCT lower(regexp_extract(source_path, '([^/]*)$', 1)) AS bn, source_path AS captured FROM episodes WHERE source_path IS NOT NULL)
SELECT target, count(*) AS captures, min(captured) AS first_capture FROM m JOIN c USING (bn) WHERE bn <> '' GROUP BY target
""")
def join07_captured_basenames(spark: SparkSession, d: str) -> DataFrame:
    """Missing targets with the captured paths of the same name."""
    e = table(spark, d, "episodes")
    m = table(spark, d, "works").select(F.explode("episodes.episode_id").alias("target")).where("target is not null").distinct().join(e.select(F.col("episode_id").alias("target")), "target", "left_anti")
    name = lambda c: F.lower(urls.basename(c))
    c = e.where("source_path is not null").select(name(F.col("source_path")).alias("bn"), F.col("source_path").alias("captured")).distinct()
    m = m.withColumn("bn", name(F.replace("target", F.lit("__"), F.lit("/")))).where("bn <> ''")
    return m.join(c, "bn").groupBy("target").agg(F.count("*").alias("captures"), F.min("captured").alias("first_capture"))


@query("""
WITH h AS (SELECT x.episode_id AS href, min(work_slug) AS w FROM (SELECT work_slug, unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL GROUP BY 1), t AS (SELECT title, min(work_slug) AS w FROM works WHERE title IS NOT NULL GROUP BY 1)
SELECT e.entry_no, coalesce(h.w, t.w) AS work, CASE WHEN h.w IS NOT NULL THEN 'href' WHEN t.w IS NOT NULL THEN 'index' ELSE 'none' END AS tier FROM episodes e LEFT JOIN h ON e.episode_id = h.href LEFT JOIN t ON e.title = t.title
""")
def join09_first_holder(spark: SparkSession, d: str) -> DataFrame:
    """The first work that links to a line, else the first of its title."""
    w = table(spark, d, "works")
    h = w.select("work_slug", F.explode("episodes.episode_id").alias("episode_id")).where("episode_id is not null").groupBy("episode_id").agg(F.min("work_slug").alias("_h"))
    t = w.where("title is not null").groupBy("title").agg(F.min("work_slug").alias("_t"))
    e = table(spark, d, "episodes").select("entry_no", "episode_id", "title").join(h, "episode_id", "left").join(t, "title", "left")
    return e.select("entry_no", F.coalesce("_h", "_t").alias("work"), F.when(F.col("_h").isNotNull(), "href").when(F.col("_t").isNotNull(), "index").otherwise("none").alias("tier"))


@query(f"""
WITH f AS (SELECT DISTINCT user_id FROM {_CAPTURES} WHERE status <> '200'), c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM {_CAPTURES} WHERE status = '200')
SELECT user_id, event_id, rn AS attempt FROM c JOIN f USING (user_id) WHERE rn <= 12
""")
def join10_retries(spark: SparkSession, d: str) -> DataFrame:
    """Failed fetches with the captures to try instead, newest first, twelve at most."""
    c = _captures(spark, d)
    r = records.ranked(c.where("status = '200'"), ["user_id"], [F.desc("ts"), F.col("event_id")], "attempt").where("attempt <= 12")
    return r.join(c.where("status <> '200'").select("user_id"), "user_id", "left_semi").select("user_id", "event_id", "attempt")


@query(f"""
WITH n AS (SELECT event_id, lower(regexp_replace(regexp_extract(url, '^http://([^/]+)', 1), '^www\\d*\\.', '')) AS host, lower(regexp_extract(url, '^http://[^/]+(.*)$', 1)) AS path, status FROM {_CAPTURES})
SELECT a.event_id AS wanted, min(b.event_id) AS held FROM n a JOIN n b USING (host, path) WHERE a.status <> '200' AND b.status = '200' GROUP BY 1
""")
def join11_archived(spark: SparkSession, d: str) -> DataFrame:
    """Failed fetches held elsewhere under the same host but for www, path but for case, and query but for order."""
    from corpusloom.operators.links import query_key

    q = F.regexp_extract("url", r"\?(.*)$", 1)
    n = _captures(spark, d).select("event_id", "status", F.lower(F.regexp_replace(F.regexp_extract("url", "^http://([^/]+)", 1), r"^www\d*\.", "")).alias("host"), F.lower(F.regexp_replace(F.regexp_extract("url", "^http://[^/]+(.*)$", 1), r"\?.*$", "")).alias("path"), query_key(q).alias("q"))
    held = n.where("status = '200'").groupBy("host", "path", "q").agg(F.min("event_id").alias("held"))
    return n.where("status <> '200'").join(held, ["host", "path", "q"]).select(F.col("event_id").alias("wanted"), "held")


@query("""
WITH c AS (SELECT episode_id, count(*) AS n FROM episodes GROUP BY 1), r AS (SELECT DISTINCT episode_id AS key FROM episodes WHERE ends_with(episode_id, '1.html') UNION SELECT 'novel__no__such.html')
SELECT r.key, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'ambiguous' WHEN e.route = 'first' THEN 'already' ELSE 'changed' END AS outcome FROM r LEFT JOIN c ON c.episode_id = r.key LEFT JOIN (SELECT episode_id, min(route) AS route FROM episodes GROUP BY 1) e ON e.episode_id = r.key
""")
def join12_override_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each override: changed, already so, no such line or several."""
    e = table(spark, d, "episodes").where("episode_id is not null").select("entry_no", "episode_id", "route")
    keys = e.where("episode_id like '%1.html'").select(F.col("episode_id").alias("key")).distinct().unionByName(spark.createDataFrame([("novel__no__such.html",)], "key string"))
    rules = keys.select("key", F.lit("route").alias("field"), F.lit("first").alias("value"), F.lit(None).cast("string").alias("expect"))
    return records.overridden(e, rules, "episode_id", ["route"])[1].select("key", "outcome").distinct()


@query("""
WITH p AS (SELECT source_path, min(loaded_at) AS at, min(recorder) AS by FROM episodes WHERE source_path IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1)
SELECT e.entry_no, strftime(p.at, '%Y-%m-%d') AS acquired, p.by FROM episodes e LEFT JOIN p USING (source_path)
""")
def join13_provenance(spark: SparkSession, d: str) -> DataFrame:
    """When and by whom each file first came in."""
    p = table(spark, d, "episodes").where("source_path is not null and loaded_at is not null").groupBy("source_path").agg(F.min("loaded_at").alias("at"), F.min("recorder").alias("by"))
    return table(spark, d, "episodes").select("entry_no", "source_path").join(p, "source_path", "left").select("entry_no", F.date_format("at", "yyyy-MM-dd").alias("acquired"), "by")


@query("""
WITH n AS (SELECT DISTINCT kansou_slug AS board, slug, unnest(list_concat([display_name], coalesce(display_variants, []))) AS name FROM authors WHERE kansou_slug IS NOT NULL), s AS (SELECT board FROM n GROUP BY board HAVING count(DISTINCT slug) > 1)
SELECT DISTINCT board, name FROM n WHERE name IS NOT NULL AND board NOT IN (SELECT board FROM s)
""")
def join16_board_names(spark: SparkSession, d: str) -> DataFrame:
    """Names on boards of one person; shared boards are left out."""
    a = table(spark, d, "authors").where("kansou_slug is not null")
    shared = a.groupBy(F.col("kansou_slug").alias("board")).agg(F.count_distinct("slug").alias("n")).where("n > 1").select("board")
    names = F.concat(F.array("display_name"), F.coalesce("display_variants", F.array().cast("array<string>")))
    return a.select(F.col("kansou_slug").alias("board"), F.explode(names).alias("name")).where("name is not null").distinct().join(shared, "board", "left_anti")


@query("""
WITH i AS (SELECT DISTINCT work_slug, author_slug, unnest([credit, title]) AS name FROM works)
SELECT DISTINCT a.slug, i.work_slug FROM (SELECT DISTINCT slug, display_name FROM authors) a JOIN i ON i.name = a.display_name WHERE i.author_slug IS DISTINCT FROM a.slug
""")
def join24_illustrated(spark: SparkSession, d: str) -> DataFrame:
    """Works that name a person among their hands without being that person's own."""
    i = table(spark, d, "works").select("work_slug", "author_slug", F.explode(F.array("credit", "title")).alias("display_name")).where("display_name is not null").distinct()
    a = table(spark, d, "authors").select("slug", "display_name").distinct()
    return a.join(i, "display_name").where("not author_slug <=> slug").select("slug", "work_slug").distinct()


@query("""
WITH p AS (SELECT episode_id, bool_or(coalesce(entry_role = 'work', false)) AS good FROM episodes WHERE episode_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN p.episode_id IS NULL THEN 'missing' ELSE 'wrong-type' END AS problem FROM documents d LEFT JOIN p USING (episode_id) WHERE d.episode_id IS NOT NULL AND (p.episode_id IS NULL OR NOT p.good)
""")
def join26_bad_parents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose episode is missing or no work."""
    p = table(spark, d, "episodes").where("episode_id is not null").groupBy("episode_id").agg(F.bool_or(F.coalesce(F.col("entry_role") == "work", F.lit(False))).alias("_good"))
    c = table(spark, d, "documents").where("episode_id is not null").select("doc_id", "episode_id").join(p, "episode_id", "left")
    return c.where("_good is null or not _good").select("doc_id", F.when(F.col("_good").isNull(), "missing").otherwise("wrong-type").alias("problem"))


@query("SELECT entry_no AS request FROM episodes WHERE entry_no % 10 = 0 AND entry_no NOT IN (SELECT entry_no FROM episodes WHERE withdrawn_at IS NOT NULL)")
def join28_unlisted_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose number no reason of the deny list holds."""
    e = table(spark, d, "episodes")
    listed = e.where("withdrawn_at is not null").select(F.concat(F.lit("taken down (req:"), "entry_no", F.lit(")")).alias("reason")).select(F.regexp_extract("reason", r"req:(\d+)", 1).cast("long").alias("request"))
    return e.where("entry_no % 10 = 0").select(F.col("entry_no").alias("request")).join(listed, "request", "left_anti")


@query("""
WITH m AS (SELECT x.episode_id AS e, min(work_slug) AS w FROM (SELECT work_slug, unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT d.source AS src, m.w AS dst FROM documents d JOIN m ON d.episode_id = m.e WHERE d.source IS NOT NULL)
SELECT dst AS node, count(*) AS incoming, array_to_string(list_slice(list_sort(list(src)), 1, 5), ',') AS first_sources FROM r GROUP BY dst
""")
def join30_recommended(spark: SparkSession, d: str) -> DataFrame:
    """Works with those that point to them, the reverse of the links."""
    m = table(spark, d, "works").select("work_slug", F.explode("episodes.episode_id").alias("episode_id")).where("episode_id is not null").groupBy("episode_id").agg(F.min("work_slug").alias("node"))
    r = table(spark, d, "documents").where("source is not null").select("source", "episode_id").join(m, "episode_id").select("source", "node").distinct()
    return records.first_few(r, ["node"], "source", 5).select("node", F.col("n").alias("incoming"), F.array_join("few", ",").alias("first_sources"))


@query("""
WITH l AS (SELECT DISTINCT source_path FROM episodes WHERE corpus = 'legacy' AND source_path IS NOT NULL)
SELECT DISTINCT e.source_path, CASE WHEN l.source_path IS NOT NULL THEN 'http://old.example/' || l.source_path END AS old_url FROM episodes e LEFT JOIN l USING (source_path) WHERE e.source_path IS NOT NULL AND e.corpus IS DISTINCT FROM 'legacy'
""")
def join33_older_tree(spark: SparkSession, d: str) -> DataFrame:
    """Paths with their address in an older tree where it has them."""
    e = table(spark, d, "episodes").where("source_path is not null").select("corpus", "source_path")
    old = e.where("corpus = 'legacy'").select("source_path", F.concat(F.lit("http://old.example/"), "source_path").alias("old_url")).distinct()
    return e.where("not corpus <=> 'legacy'").select("source_path").distinct().join(old, "source_path", "left")


# ---- counts


@query("""
WITH l AS (SELECT x.episode_id AS t FROM (SELECT unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL), k AS (SELECT DISTINCT episode_id FROM episodes WHERE episode_id IS NOT NULL)
SELECT count(*) AS scanned, count(*) FILTER (t IN (SELECT episode_id FROM k)) AS resolved, count(*) FILTER (t NOT IN (SELECT episode_id FROM k)) AS missing, count(DISTINCT t) AS distinct_targets FROM l
""")
def agg02_link_counters(spark: SparkSession, d: str) -> DataFrame:
    """Links scanned, resolved and missing, and distinct targets."""
    k = table(spark, d, "episodes").where("episode_id is not null").select(F.col("episode_id").alias("t"), F.lit(True).alias("_k")).distinct()
    # links of one target are counted before they meet the known ones
    n = table(spark, d, "works").select(F.explode("episodes.episode_id").alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n")).join(k, "t", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return n.agg(total("n").alias("scanned"), total(F.when(F.col("_k"), F.col("n")).otherwise(0)).alias("resolved"), total(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("*").alias("distinct_targets"))


@query("SELECT corpus, round(100.0 * count(date) / count(*), 2) AS pct, 0.0::DOUBLE AS empty_pct FROM episodes GROUP BY corpus")
def agg07_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Shares in percent; of nothing it is nought."""
    e = table(spark, d, "episodes").groupBy("corpus").agg(F.count("date").alias("d"), F.count("*").alias("n"))
    return e.select("corpus", records.percent(F.col("d"), F.col("n")).alias("pct"), records.percent(F.col("d"), F.lit(0)).alias("empty_pct"))


@query("SELECT regexp_extract(source_path, '([^/]*)$', 1) AS name, count(DISTINCT coalesce(size_kb, -1)) = 1 AS one_size, count(*) AS n FROM episodes WHERE source_path IS NOT NULL GROUP BY 1")
def agg10_one_size(spark: SparkSession, d: str) -> DataFrame:
    """Names of files and whether all files of a name have one size."""
    e = table(spark, d, "episodes").where("source_path is not null")
    s = F.coalesce("size_kb", F.lit(-1))
    return e.groupBy(urls.basename(F.col("source_path")).alias("name")).agg((F.min(s) == F.max(s)).alias("one_size"), F.count("*").alias("n"))


@query("SELECT taxonomy, count(*) AS relationships, count(DISTINCT term_no) AS terms FROM (SELECT taxonomy, term_no, unnest(raw_variants) AS r FROM terms) WHERE r IS NOT NULL GROUP BY taxonomy")
def agg22_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Typed values of each taxonomy."""
    return table(spark, d, "terms").select("taxonomy", "term_no", F.explode("raw_variants").alias("r")).where("r is not null").groupBy("taxonomy").agg(F.count("*").alias("relationships"), F.count_distinct("term_no").alias("terms"))


@query("""
WITH o AS (SELECT DISTINCT work_slug AS old, x.episode_id AS e FROM (SELECT work_slug, unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL), n AS (SELECT e, min(old) AS new FROM o GROUP BY e),
m AS (SELECT old, count(DISTINCT new) AS targets, min(new) AS one, count(*) AS n FROM o JOIN n USING (e) GROUP BY old), s AS (SELECT new, count(*) AS k FROM n GROUP BY new)
SELECT count(*) FILTER (targets > 1 OR one <> old) AS moved, count(*) FILTER (targets = 1 AND one <> old AND s.k <> m.n) AS merged, count(*) AS works FROM m LEFT JOIN s ON s.new = m.one
""")
def agg29_moved_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Works that moved, and those of them that went into one work of another size."""
    o = table(spark, d, "works").select(F.col("work_slug").alias("old"), F.explode("episodes.episode_id").alias("e")).where("e is not null").distinct()
    n = o.groupBy("e").agg(F.min("old").alias("new"))
    m = o.join(n, "e").groupBy("old").agg(F.min("new").alias("one"), F.max("new").alias("last"), F.count("*").alias("n"))
    s = n.groupBy(F.col("new").alias("one")).agg(F.count("*").alias("k"))
    one = F.col("one") == F.col("last")
    return m.join(s, "one", "left").agg(F.count_if(~one | (F.col("one") != F.col("old"))).alias("moved"), F.count_if(one & (F.col("one") != F.col("old")) & (F.col("k") != F.col("n"))).alias("merged"), F.count("*").alias("works"))


# ---- orders and sets


@query("SELECT source_path, row_number() OVER (ORDER BY source_path) - 1 AS place FROM (SELECT DISTINCT source_path FROM episodes WHERE source_path IS NOT NULL)")
def srt02_total_order(spark: SparkSession, d: str) -> DataFrame:
    """Every path with its place in the order of all, each range of it in a task of its own."""
    return records.numbered(table(spark, d, "episodes").select("source_path").where("source_path is not null").distinct(), ["source_path"], "place")[0]


@query("SELECT kansou_slug, n, first_entry FROM (SELECT kansou_slug, count(*) AS n, min(entry_no) AS first_entry FROM episodes WHERE kansou_slug IS NOT NULL GROUP BY 1) ORDER BY n DESC, first_entry LIMIT 40")
def srt04_size_then_place(spark: SparkSession, d: str) -> DataFrame:
    """The largest boards, older ones first among equals."""
    return table(spark, d, "episodes").where("kansou_slug is not null").groupBy("kansou_slug").agg(F.count("*").alias("n"), F.min("entry_no").alias("first_entry")).orderBy(F.desc("n"), "first_entry").limit(40)


@query("SELECT work_slug FROM (SELECT DISTINCT work_slug FROM works) ORDER BY md5(work_slug || '|20260830'), work_slug LIMIT 12")
def srt08_random_dozen(spark: SparkSession, d: str) -> DataFrame:
    """Twelve works by a seeded hash."""
    return table(spark, d, "works").select("work_slug").distinct().orderBy(F.md5(F.concat("work_slug", F.lit("|20260830"))), "work_slug").limit(12)


@query("SELECT kansou_slug, count(DISTINCT author) AS names, array_to_string(list_slice(list_sort(list_distinct(list(author))), 1, 8), '|') AS first_names FROM episodes WHERE kansou_slug IS NOT NULL AND author IS NOT NULL GROUP BY 1")
def srt11_capped_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first eight names of each board and how many there are."""
    names = table(spark, d, "episodes").where("kansou_slug is not null and author is not null").select("kansou_slug", "author").distinct()
    return records.first_few(names, ["kansou_slug"], "author", 8).select("kansou_slug", F.col("n").alias("names"), F.array_join("few", "|").alias("first_names"))


@query("SELECT episode_id, strftime(max(withdrawn_at), '%Y-%m-%d') AS day FROM episodes WHERE withdrawn_at IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1 ORDER BY max(withdrawn_at) DESC, episode_id LIMIT 100")
def srt12_removed_list(spark: SparkSession, d: str) -> DataFrame:
    """What was removed, newest first, one line each."""
    e = table(spark, d, "episodes").where("withdrawn_at is not null and episode_id is not null").groupBy("episode_id").agg(F.max("withdrawn_at").alias("at"))
    return e.orderBy(F.desc("at"), "episode_id").limit(100).select("episode_id", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("SELECT source_path AS path FROM episodes UNION SELECT replace(episode_id, '__', '/') FROM documents")
def set03_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """Paths of lines and documents, each once."""
    return table(spark, d, "episodes").select(F.col("source_path").alias("path")).union(table(spark, d, "documents").select(F.replace("episode_id", F.lit("__"), F.lit("/")))).distinct()


@query("SELECT slug FROM vocabulary WHERE taxonomy = 'ts_genre' AND name NOT IN (SELECT g FROM (SELECT unnest(genre_raw) AS g FROM episodes) WHERE g IS NOT NULL) AND slug NOT IN (SELECT g FROM (SELECT unnest(genre_raw) AS g FROM episodes) WHERE g IS NOT NULL)")
def set08_never_shown(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the vocabulary that no line shows."""
    g = table(spark, d, "episodes").select(F.explode("genre_raw").alias("g")).where("g is not null").distinct()
    v = table(spark, d, "vocabulary").where("taxonomy = 'ts_genre'").select("slug", "name")
    return v.join(g, v["name"] == g["g"], "left_anti").join(g, v["slug"] == g["g"], "left_anti").select("slug")


# ---- checks

_EXPECT = {"episodes": "episode_id IS NOT NULL", "works": "work_slug IS NOT NULL", "authors": "slug <> ''", "terms": "taxonomy IS NOT NULL"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) FILTER ({p}) AS held, count(*) AS expected, count(*) FILTER ({p}) = count(*) AS ok FROM {t}" for t, p in _EXPECT.items()))
def dq02_expected_values(spark: SparkSession, d: str) -> DataFrame:
    """Predicates with the counts they must have."""
    from functools import reduce

    rows = [table(spark, d, t).agg(F.count_if(F.expr(p)).alias("held"), F.count("*").alias("expected")).select(F.lit(t).alias("name"), "held", "expected", (F.col("held") == F.col("expected")).alias("ok")) for t, p in _EXPECT.items()]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT entry_no, false AS leak, 1 AS dropped FROM episodes")
def dq03_no_leaks(spark: SparkSession, d: str) -> DataFrame:
    """No dropped address is left in what is written."""
    from corpusloom.plans.pages import _cat, solid

    r = text.scrubbed_mailto(_cat('<a href="mailto:taro@mail.jp">', solid("title"), "n</a>"))
    e = table(spark, d, "episodes").select("entry_no", r.alias("r"))
    left = F.exists("r.dropped", lambda a: F.contains(F.col("r.html"), a))
    return e.select("entry_no", (left | text.has_leak(F.col("r.html"))).alias("leak"), F.size("r.dropped").alias("dropped"))


@query("SELECT count(*) AS parsed, count(DISTINCT episode_id) AS added, count(*) - count(DISTINCT episode_id) AS duplicates, true AS ok FROM episodes WHERE episode_id IS NOT NULL")
def dq04_row_identity(spark: SparkSession, d: str) -> DataFrame:
    """Lines added are lines parsed less the repeated ones."""
    e = table(spark, d, "episodes").where("episode_id is not null").groupBy("episode_id").agg(F.count("*").alias("n"))
    g = e.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parsed"), F.count("*").alias("added"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return g.withColumn("ok", F.col("added") == F.col("parsed") - F.col("duplicates"))


@query("""
SELECT 'works' AS name, count(*) = count(DISTINCT work_slug) AS keys_unique, count(work_slug) = count(*) AS keys_filled FROM (SELECT DISTINCT * FROM works) UNION ALL SELECT 'authors', count(*) = count(DISTINCT slug), count(slug) = count(*) FROM (SELECT DISTINCT * FROM authors)
UNION ALL SELECT 'episodes', count(*) = count(DISTINCT entry_no), count(entry_no) = count(*) FROM (SELECT DISTINCT * FROM episodes)
""")
def dq05_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys are unique and filled, exact repeats counted once."""
    from functools import reduce

    rows = []
    for t, k in (("works", "work_slug"), ("authors", "slug"), ("episodes", "entry_no")):
        g = table(spark, d, t).distinct().agg(F.count("*").alias("n"), F.count_distinct(k).alias("u"), F.count(k).alias("f"))
        rows.append(g.select(F.lit(t).alias("name"), (F.col("n") == F.col("u")).alias("keys_unique"), (F.col("f") == F.col("n")).alias("keys_filled")))
    return reduce(DataFrame.unionByName, rows)


@query("SELECT 0 AS differing, count(*) AS lines FROM episodes WHERE episode_id IS NOT NULL")
def dq06_keys_kept(spark: SparkSession, d: str) -> DataFrame:
    """Overrides leave the keys as they were."""
    e = table(spark, d, "episodes").where("episode_id is not null").select("entry_no", "episode_id", "route")
    rules = e.select(F.col("episode_id").alias("key"), F.lit("route").alias("field"), F.lit("first").alias("value"), F.lit(None).cast("string").alias("expect")).distinct()
    k = ["entry_no", "episode_id"]
    out = records.overridden(e, rules, "episode_id", ["route"])[0].select(*k).withColumn("_s", F.lit(1))
    both = out.unionByName(e.select(*k).withColumn("_s", F.lit(-1))).groupBy(*k).agg(F.sum("_s").alias("_s"))
    return both.agg(F.count_if(F.col("_s") != 0).cast("int").alias("differing"), F.count("*").alias("lines"))


@query("""
WITH m AS (SELECT DISTINCT x.episode_id AS e FROM (SELECT unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL), k AS (SELECT DISTINCT episode_id AS e FROM episodes WHERE episode_id IS NOT NULL)
SELECT (SELECT count(*) FROM m WHERE e NOT IN (SELECT e FROM k)) AS orphans, (SELECT count(*) FROM k WHERE e NOT IN (SELECT e FROM m)) AS unheld
""")
def dq07_membership(spark: SparkSession, d: str) -> DataFrame:
    """Members that are no lines, and lines that no work holds."""
    m = table(spark, d, "works").select(F.explode("episodes.episode_id").alias("e")).where("e is not null").distinct().withColumn("_m", F.lit(1))
    k = table(spark, d, "episodes").where("episode_id is not null").select(F.col("episode_id").alias("e")).distinct().withColumn("_k", F.lit(1))
    return m.join(k, "e", "full_outer").agg(F.count_if(F.col("_k").isNull()).alias("orphans"), F.count_if(F.col("_m").isNull()).alias("unheld"))


@query("""
WITH n AS (SELECT doc_id, regexp_extract(text, '(novel[/_][^\\s<>]*)', 1) AS told, episode_id FROM documents WHERE kind = 'notice'), d AS (SELECT DISTINCT episode_id FROM episodes WHERE withdrawn_at IS NOT NULL)
SELECT doc_id, episode_id IN (SELECT episode_id FROM d WHERE episode_id IS NOT NULL) AS listed FROM n WHERE episode_id IS NOT NULL
""")
def dq08_notices_listed(spark: SparkSession, d: str) -> DataFrame:
    """Whether the episode of a notice is on the deny list."""
    deny = table(spark, d, "episodes").where("withdrawn_at is not null and episode_id is not null").select("episode_id", F.lit(True).alias("_d")).distinct()
    n = table(spark, d, "documents").where("kind = 'notice' and episode_id is not null").select("doc_id", "episode_id")
    return n.join(deny, "episode_id", "left").select("doc_id", F.coalesce("_d", F.lit(False)).alias("listed"))


@query("""
WITH g AS (SELECT genre, count(DISTINCT episode_id) AS n FROM (SELECT episode_id, unnest(genre_raw) AS genre FROM episodes) WHERE genre IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1) SELECT genre, n AS loaded, n AS recomputed, true AS ok FROM g
""")
def dq09_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what was loaded against counts made another way."""
    e = table(spark, d, "episodes").where("episode_id is not null")
    loaded = e.select("episode_id", F.explode("genre_raw").alias("genre")).where("genre is not null").distinct().groupBy("genre").agg(F.count("*").alias("loaded"))
    # the other way: genres of an id are united first
    again = e.groupBy("episode_id").agg(F.array_distinct(F.flatten(F.collect_list("genre_raw"))).alias("g")).select(F.explode("g").alias("genre")).where("genre is not null").groupBy("genre").agg(F.count("*").alias("recomputed"))
    return loaded.join(again, "genre", "full_outer").select("genre", "loaded", "recomputed", F.col("loaded").eqNullSafe(F.col("recomputed")).alias("ok"))


@query("""
WITH k AS (SELECT DISTINCT corpus FROM episodes WHERE corpus IS NOT NULL), a AS (SELECT unnest(['honkan', 'legacy', 'no-such-corpus']) AS corpus)
SELECT coalesce(k.corpus, a.corpus) AS corpus, CASE WHEN a.corpus IS NULL THEN 'problem' WHEN k.corpus IS NULL THEN 'unused-rule' ELSE 'allowed' END AS state FROM k FULL JOIN a USING (corpus)
""")
def dq11_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Values outside an allow list, and its rules that nothing meets."""
    k = table(spark, d, "episodes").select("corpus").where("corpus is not null").distinct().withColumn("_k", F.lit(1))
    a = spark.createDataFrame([("honkan", 1), ("legacy", 1), ("no-such-corpus", 1)], "corpus string, _a int")
    return k.join(a, "corpus", "full_outer").select("corpus", F.when(F.col("_a").isNull(), "problem").when(F.col("_k").isNull(), "unused-rule").otherwise("allowed").alias("state"))


# ---- serving


@query("""
WITH g AS (SELECT DISTINCT entry_no, date, unnest(genre_raw) AS g FROM episodes WHERE withdrawn_at IS NULL)
SELECT g AS term, entry_no FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY date NULLS FIRST, entry_no) AS rn FROM g WHERE g IS NOT NULL) WHERE rn <= 60
""")
def qry02_term_archive(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every term's archive, by date."""
    g = table(spark, d, "episodes").where("withdrawn_at is null").select("entry_no", "date", F.explode("genre_raw").alias("term")).where("term is not null").distinct()
    return records.ranked(g, ["term"], [F.col("date").asc_nulls_first(), F.col("entry_no")], "rn").where("rn <= 60").select("term", "entry_no")


@query("""
WITH m AS (SELECT DISTINCT author_slug, work_slug FROM works WHERE author_slug IS NOT NULL)
SELECT work_slug, author_slug, coalesce(lead(work_slug) OVER (PARTITION BY author_slug ORDER BY work_slug), first_value(work_slug) OVER (PARTITION BY author_slug ORDER BY work_slug)) AS next_work FROM m
""")
def qry06_ring(spark: SparkSession, d: str) -> DataFrame:
    """The ring of an author's works: each leads to the next, the last to the first."""
    w = Window.partitionBy("author_slug").orderBy("work_slug")
    m = table(spark, d, "works").where("author_slug is not null").select("author_slug", "work_slug").distinct()
    return m.select("work_slug", "author_slug", F.coalesce(F.lead("work_slug").over(w), F.first("work_slug").over(w)).alias("next_work"))


@query("SELECT kind, coalesce(lang, '-') AS lang, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2")
def qry07_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents by section."""
    return table(spark, d, "documents").groupBy("kind", F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


# ---- clusters and merges


@query(f"""
WITH f AS (SELECT work_slug, eid, core, lower(left(coalesce(core, ''), 2)) AS start, ord FROM {_CORE} WHERE evidence IS NOT NULL AND len(list_filter(evidence, lambda x: x NOT IN ('filename-stem', 'title-prefix', 'title', 'directory'))) = 0),
g AS (SELECT work_slug, start, count(*) AS n, min(ord) AS first_ord, min(eid) AS first_eid FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY work_slug ORDER BY n DESC, first_ord, start) AS rn, count(*) OVER (PARTITION BY work_slug) AS k FROM g)
SELECT work_slug, start, n, CASE WHEN k = 1 OR rn = 1 THEN 'keep' WHEN n >= 2 THEN 'split' ELSE 'detach' END AS proposal FROM r
""")
def grf05_proposals(spark: SparkSession, d: str) -> DataFrame:
    """What to do with the title families of weakly founded works: the largest stays, others split off or go alone."""
    weak = F.array(*[F.lit(x) for x in _WEAK])
    f = _cores(spark, d).where(F.col("evidence").isNotNull() & (F.size(F.array_except("evidence", weak)) == 0)).withColumn("start", F.lower(F.substring(F.coalesce("core", F.lit("")), 1, 2)))
    return records.proposals(f, "work_slug", "start", "ord")


@query("""
WITH b AS (SELECT author_slug, work_slug, count(*) AS n FROM (SELECT DISTINCT author_slug, work_slug FROM works WHERE author_slug IS NOT NULL) GROUP BY ALL),
m AS (SELECT author_slug, min(work_slug) AS into_ FROM b GROUP BY 1)
SELECT DISTINCT w.work_slug, CASE WHEN w.work_slug <> m.into_ AND ends_with(w.work_slug, '2') THEN m.into_ ELSE w.work_slug END AS work, CASE WHEN w.work_slug <> m.into_ AND ends_with(w.work_slug, '2') THEN 'merged' ELSE 'kept' END AS state
FROM works w LEFT JOIN m USING (author_slug)
""")
def grf03_merged_works(spark: SparkSession, d: str) -> DataFrame:
    """Works after merges by rule: same author, no chains, no work that is not there."""
    w = table(spark, d, "works").select("work_slug", "author_slug").distinct()
    first = w.where("author_slug is not null").groupBy("author_slug").agg(F.min("work_slug").alias("into"))
    rules = w.where("work_slug like '%2'").join(first, "author_slug").where("work_slug <> into").select(F.col("work_slug").alias("merge"), "into")
    out, _ = records.merged_works(w, rules)
    return out.select("work_slug", "work", F.when(F.col("work") != F.col("work_slug"), "merged").otherwise("kept").alias("state")).distinct()


@query("""
WITH a AS (SELECT DISTINCT slug, kansou_slug, slug_status, display_name FROM authors), b AS (SELECT kansou_slug FROM a WHERE kansou_slug IS NOT NULL GROUP BY 1 HAVING count(DISTINCT slug) = 1)
SELECT CASE WHEN a.kansou_slug IN (SELECT kansou_slug FROM b) THEN 'board:' || a.kansou_slug WHEN a.slug_status = 'confirmed' THEN 'slug:' || a.slug ELSE 'name:' || coalesce(lower(replace(a.display_name, ' ', '')), a.slug) END AS entity, count(DISTINCT slug) AS slugs, min(slug) AS first_slug FROM a GROUP BY 1
""")
def grf06_author_entities(spark: SparkSession, d: str) -> DataFrame:
    """Author records as entities: by a board of their own, else a confirmed slug, else the name."""
    a = table(spark, d, "authors").select("slug", "kansou_slug", "slug_status", "display_name").distinct()
    own = a.where("kansou_slug is not null").groupBy("kansou_slug").agg((F.min("slug") == F.max("slug")).alias("_own")).where("_own")
    name = F.coalesce(F.lower(F.replace("display_name", F.lit(" "), F.lit(""))), F.col("slug"))
    entity = F.when(F.col("_own"), F.concat(F.lit("board:"), "kansou_slug")).when(F.col("slug_status") == "confirmed", F.concat(F.lit("slug:"), "slug")).otherwise(F.concat(F.lit("name:"), name))
    return a.join(own, "kansou_slug", "left").groupBy(entity.alias("entity")).agg(F.count_distinct("slug").alias("slugs"), F.min("slug").alias("first_slug"))


@query("""
WITH h AS (SELECT md5(text) AS h, doc_id, ingested_at FROM documents WHERE text IS NOT NULL), g AS (SELECT h, arg_min(doc_id, (ingested_at, doc_id)) AS canonical, count(*) AS n FROM h WHERE ingested_at IS NOT NULL GROUP BY h HAVING count(*) > 1)
SELECT h.doc_id, g.canonical, g.n FROM h JOIN g USING (h) WHERE h.ingested_at IS NOT NULL AND h.doc_id <> g.canonical
""")
def grf07_alias_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with the bytes of an earlier one."""
    h = table(spark, d, "documents").where("text is not null and ingested_at is not null").select("doc_id", "ingested_at", F.md5("text").alias("h"))
    g = h.groupBy("h").agg(F.min(F.struct("ingested_at", "doc_id"))["doc_id"].alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return h.join(g, "h").where("doc_id <> canonical").select("doc_id", "canonical", "n")


_SAME = ["corpus", "title", "author", "kansou_slug", "size_kb"]


@query("SELECT 'skip' AS action, count(DISTINCT episode_id) AS n FROM episodes WHERE episode_id IS NOT NULL")
def mrg02_second_run(spark: SparkSession, d: str) -> DataFrame:
    """A second run over what the first one loaded creates and updates nothing."""
    e = table(spark, d, "episodes").where("episode_id is not null")
    new = records.best_per_key(e, ["episode_id"], [F.desc("entry_no")])
    return records.merge_plan(new, new, "episode_id", _SAME).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT slug, bool_or(withdrawn_at > registered_at + INTERVAL 2 SECOND) AS edited FROM authors WHERE registered_at IS NOT NULL GROUP BY slug")
def mrg03_edited_by_hand(spark: SparkSession, d: str) -> DataFrame:
    """Rows changed more than two seconds after they were loaded."""
    a = table(spark, d, "authors").where("registered_at is not null")
    return a.groupBy("slug").agg(F.bool_or(records.edited(F.col("withdrawn_at"), F.col("registered_at"))).alias("edited"))


@query("SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def mrg04_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as page files and read back are as they were."""
    page = records.page_file(F.concat(F.lit("t"), F.col("doc_id")), F.col("text"))
    back = records.read_page_file(page)
    return table(spark, d, "documents").where("text is not null").select("doc_id", ((back["title"] == F.concat(F.lit("t"), "doc_id")) & (back["content"] == F.regexp_replace("text", r"[\r\n]+$", ""))).alias("same"))


@query("SELECT kind, count(*) AS n FROM documents WHERE kind NOT IN ('notice', 'comment') GROUP BY kind")
def mrg10_reset(spark: SparkSession, d: str) -> DataFrame:
    """What is left after the derived kinds are dropped."""
    return table(spark, d, "documents").where(~F.col("kind").isin("notice", "comment")).groupBy("kind").agg(F.count("*").alias("n"))
