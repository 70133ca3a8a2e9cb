"""Queries of the remaining lookups, rollups, orders and listings of the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import links, records
from corpusloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH h AS (SELECT * FROM (VALUES ('members.example', '/', 'members'), ('members.example', '/~3', 'members-3'), ('home.example', '', 'home')) t(host, prefix, place)),
u AS (SELECT DISTINCT regexp_extract(homepage, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(homepage, '^[a-z]+://[^/]+(.*)$', 1) AS rest FROM authors WHERE homepage IS NOT NULL)
SELECT host, rest, place FROM (SELECT u.host, u.rest, h.place, row_number() OVER (PARTITION BY u.host, u.rest ORDER BY length(h.prefix) DESC NULLS LAST, h.prefix) AS rn
  FROM u LEFT JOIN h ON u.host = h.host AND starts_with(u.rest, h.prefix)) WHERE rn = 1
""")
def join03_longest_host(spark: SparkSession, d: str) -> DataFrame:
    """Homepages in the host table, the longest path prefix counting."""
    h = "homepage"
    u = table(spark, d, "authors").where("homepage is not null").select(F.regexp_extract(h, "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract(h, "^[a-z]+://[^/]+(.*)$", 1).alias("rest")).distinct()
    hosts = spark.createDataFrame([("members.example", "/", "members"), ("members.example", "/~3", "members-3"), ("home.example", "", "home")], "host string, prefix string, place string")
    return links.longest_host(u, "host", "rest", hosts).select("host", "rest", "place")


@query("""
WITH t AS (SELECT work_slug, title, row_number() OVER (PARTITION BY title ORDER BY work_slug) AS rn FROM works WHERE title IS NOT NULL)
SELECT e.entry_no, t.work_slug FROM episodes e LEFT JOIN t ON e.title = t.title AND t.rn = 1 WHERE e.title IS NOT NULL
""")
def join14_first_title_match(spark: SparkSession, d: str) -> DataFrame:
    """Work of the same title as a line, the first counting."""
    t = table(spark, d, "works").where("title is not null").groupBy("title").agg(F.min("work_slug").alias("work_slug"))
    return table(spark, d, "episodes").where("title is not null").select("entry_no", "title").join(t, "title", "left").select("entry_no", "work_slug")


@query("""
WITH own AS (SELECT 1 AS p, source_path AS k, entry_no FROM episodes WHERE source_path IS NOT NULL UNION ALL SELECT 2, replace(episode_id, '__', '/'), entry_no FROM episodes WHERE episode_id IS NOT NULL)
SELECT k AS key, entry_no FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, entry_no) AS rn FROM own) WHERE rn = 1
""")
def join22_path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup of lines by path, then by id, the first of each key counting."""
    e = table(spark, d, "episodes")
    own = e.where("source_path is not null").select(F.lit(1).alias("p"), F.col("source_path").alias("key"), "entry_no")
    ids = e.where("episode_id is not null").select(F.lit(2).alias("p"), F.replace("episode_id", F.lit("__"), F.lit("/")).alias("key"), "entry_no")
    return own.unionByName(ids).groupBy("key").agg(F.min(F.struct("p", "entry_no")).alias("m")).select("key", "m.entry_no")


@query("""
WITH w AS (SELECT DISTINCT author_slug, work_slug, x.episode_id AS e FROM (SELECT author_slug, work_slug, unnest(episodes) AS x FROM works) WHERE author_slug IS NOT NULL)
SELECT w.author_slug, d.kind, count(DISTINCT w.work_slug) AS works, count(DISTINCT d.doc_id) AS docs FROM w JOIN documents d ON d.episode_id = w.e GROUP BY 1, 2
""")
def join25_three_way(spark: SparkSession, d: str) -> DataFrame:
    """Authors, their works and their documents by kind."""
    w = table(spark, d, "works").where("author_slug is not null").select("author_slug", "work_slug", F.explode("episodes.episode_id").alias("episode_id")).distinct()
    docs = table(spark, d, "documents").select("episode_id", "doc_id", "kind")
    return w.join(docs, "episode_id").groupBy("author_slug", "kind").agg(F.count_distinct("work_slug").alias("works"), F.count_distinct("doc_id").alias("docs"))


@query("""
WITH m AS (SELECT md5(text) AS h, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT d.doc_id, m.first_doc, m.n FROM documents d JOIN m ON md5(d.text) = m.h WHERE m.n > 1
""")
def join35_reuse_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose bytes another one holds."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    m = t.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return t.join(m, "h").select("doc_id", "first_doc", "n")


@query("""
SELECT author, count(*) AS lost, coalesce(min(kansou_slug), '-') AS board, coalesce(sum(size_kb), 0)::BIGINT AS kb FROM episodes WHERE withdrawn_at IS NOT NULL AND author IS NOT NULL GROUP BY author
""")
def agg09_lost_by_author(spark: SparkSession, d: str) -> DataFrame:
    """Withdrawn lines by author."""
    e = table(spark, d, "episodes").where("withdrawn_at is not null and author is not null")
    return e.groupBy("author").agg(F.count("*").alias("lost"), F.coalesce(F.min("kansou_slug"), F.lit("-")).alias("board"), F.coalesce(F.sum("size_kb"), F.lit(0)).alias("kb"))


@query("""
SELECT kind, count(*) AS n, count(*) FILTER (text IS NOT NULL AND text <> '') AS held, round(100.0 * count(*) FILTER (text IS NOT NULL AND text <> '') / count(*), 2) AS rate_pct,
  100.0 * count(*) FILTER (text IS NOT NULL AND text <> '') / count(*) >= 85 AS accepted FROM documents GROUP BY kind
""")
def agg14_conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text by kind, their rate and whether it is accepted."""
    held = F.count_if(F.coalesce(F.col("text") != "", F.lit(False)))
    g = table(spark, d, "documents").groupBy("kind").agg(F.count("*").alias("n"), held.alias("held"))
    return g.withColumn("rate_pct", F.round(100.0 * F.col("held") / F.col("n"), 2)).withColumn("accepted", 100.0 * F.col("held") / F.col("n") >= 85)


@query("""
SELECT 'untitled' AS category, count(*) FILTER (title IS NULL) AS n FROM episodes UNION ALL SELECT 'uncredited', count(*) FILTER (author IS NULL) FROM episodes
UNION ALL SELECT 'undated', count(*) FILTER (date IS NULL) FROM episodes UNION ALL SELECT 'all_three', count(*) FILTER (title IS NULL AND author IS NULL AND date IS NULL) FROM episodes
""")
def agg17_overlapping_categories(spark: SparkSession, d: str) -> DataFrame:
    """Lines in categories that overlap, in one pass."""
    t, a, y = (F.col(c).isNull() for c in ("title", "author", "date"))
    one = table(spark, d, "episodes").agg(F.count_if(t).alias("untitled"), F.count_if(a).alias("uncredited"), F.count_if(y).alias("undated"), F.count_if(t & a & y).alias("all_three"))
    return one.selectExpr("stack(4, 'untitled', untitled, 'uncredited', uncredited, 'undated', undated, 'all_three', all_three) AS (category, n)")


@query("""
WITH m AS (SELECT DISTINCT work_slug, x.episode_id AS e FROM (SELECT work_slug, unnest(episodes) AS x FROM works)), g AS (SELECT DISTINCT episode_id AS e, genre FROM (SELECT episode_id, unnest(genre_raw) AS genre FROM episodes) WHERE genre IS NOT NULL)
SELECT level, count(*) AS assignments FROM (SELECT 'episode' AS level, e AS k, genre FROM g UNION ALL SELECT DISTINCT 'work', work_slug, genre FROM m JOIN g USING (e)) GROUP BY level
""")
def agg23_expected_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of genres recomputed for episodes and works."""
    g = table(spark, d, "episodes").select(F.col("episode_id").alias("e"), F.explode("genre_raw").alias("genre")).where("genre is not null").distinct()
    m = table(spark, d, "works").select("work_slug", F.explode("episodes.episode_id").alias("e")).distinct()
    w = m.join(g, "e").select("work_slug", "genre").distinct()
    both = g.select(F.lit("episode").alias("level")).unionByName(w.select(F.lit("work").alias("level")))
    return both.groupBy("level").agg(F.count("*").alias("assignments"))


@query("SELECT coalesce(slug_source, '-') AS section, count(*) FILTER (slug_status IS DISTINCT FROM 'confirmed') AS pending, count(*) AS n FROM (SELECT DISTINCT * FROM authors) GROUP BY 1")
def agg25_pending(spark: SparkSession, d: str) -> DataFrame:
    """Unconfirmed slugs by source."""
    a = table(spark, d, "authors").distinct()
    return a.groupBy(F.coalesce("slug_source", F.lit("-")).alias("section")).agg(F.count_if(~F.col("slug_status").eqNullSafe("confirmed")).alias("pending"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT kansou_slug, author, count(*) AS n FROM episodes WHERE kansou_slug IS NOT NULL AND author IS NOT NULL GROUP BY ALL)
SELECT kansou_slug, author, n FROM (SELECT *, row_number() OVER (PARTITION BY kansou_slug ORDER BY n DESC, author) AS rn FROM c) WHERE rn = 1
""")
def agg27_most_common_name(spark: SparkSession, d: str) -> DataFrame:
    """The most common name on each board."""
    c = table(spark, d, "episodes").where("kansou_slug is not null and author is not null").groupBy("kansou_slug", "author").agg(F.count("*").alias("n"))
    return records.best_per_key(c, ["kansou_slug"], [F.desc("n"), F.col("author")])


@query("""
SELECT work_slug, ordinal, title, lag(title) OVER (PARTITION BY work_slug ORDER BY ordinal, episode_id) AS before FROM (
  SELECT work_slug, x.ordinal AS ordinal, x.episode_id AS episode_id, x.title AS title FROM (SELECT work_slug, unnest(episodes) AS x FROM (SELECT DISTINCT * FROM works)))
""")
def win05_previous_member(spark: SparkSession, d: str) -> DataFrame:
    """Members of works with the one before."""
    w = table(spark, d, "works").distinct().select("work_slug", F.explode("episodes").alias("x")).select("work_slug", "x.ordinal", "x.episode_id", "x.title")
    return w.select("work_slug", "ordinal", "title", F.lag("title").over(Window.partitionBy("work_slug").orderBy("ordinal", "episode_id")).alias("before"))


@query("""
WITH e AS (SELECT entry_no, source_path, lower(regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '\\.[a-z]+$', '')) AS stem, source_anchor, date FROM episodes WHERE source_path IS NOT NULL),
a AS (SELECT *, stem || coalesce('-' || lower(source_anchor), '') AS s1 FROM e),
b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s1) > 1 THEN regexp_extract(source_path, '([^/]*)/[^/]*$', 1) || '-' || s1 ELSE s1 END AS s2 FROM a),
c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s2) > 1 THEN s2 || '-' || coalesce(date, '') ELSE s2 END AS s3 FROM b)
SELECT entry_no, CASE WHEN row_number() OVER (PARTITION BY s3 ORDER BY entry_no) = 1 THEN s3 ELSE s3 || '-' || row_number() OVER (PARTITION BY s3 ORDER BY entry_no) END AS slug FROM c
""")
def win10_slug_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of lines: stem and anchor; if that repeats with the directory, then the day, then a number."""
    p = F.col("source_path")
    stem = F.lower(F.regexp_replace(urls.basename(p), r"\.[a-z]+$", ""))
    e = table(spark, d, "episodes").where("source_path is not null").select("entry_no", "source_path", "date", F.concat(stem, F.coalesce(F.concat(F.lit("-"), F.lower("source_anchor")), F.lit(""))).alias("s1"))
    several = lambda df, c: df.join(df.groupBy(c).agg(F.count("*").alias("_c")).where("_c > 1"), c, "left")
    e = several(e, "s1").withColumn("s2", F.when(F.col("_c") > 1, F.concat(F.regexp_extract(p, "([^/]*)/[^/]*$", 1), F.lit("-"), F.col("s1"))).otherwise(F.col("s1"))).drop("_c")
    e = several(e, "s2").withColumn("s3", F.when(F.col("_c") > 1, F.concat(F.col("s2"), F.lit("-"), F.coalesce("date", F.lit("")))).otherwise(F.col("s2"))).drop("_c")
    by = [F.col("entry_no")]
    e = records.numbered_within(records.in_ranges(e, ["s3"], by), ["s3"], by, "_n")
    return e.select("entry_no", F.when(F.col("_n") == 1, F.col("s3")).otherwise(F.concat(F.col("s3"), F.lit("-"), F.col("_n"))).alias("slug"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 30")
def srt01_largest_sources(spark: SparkSession, d: str) -> DataFrame:
    """The thirty largest sources."""
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(30)


@query("SELECT user_id, array_to_string(list_slice(list(event_id ORDER BY ts DESC, event_id), 1, 5), ',') AS newest FROM events GROUP BY user_id")
def srt03_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """The five newest events of each user, newest first."""
    r = records.ranked(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], "rn").where("rn <= 5")
    return r.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("newest"))


@query("""
SELECT slug, display_name FROM (SELECT slug, display_name, row_number() OVER (PARTITION BY display_name ORDER BY slug) AS rn FROM (SELECT DISTINCT slug, display_name FROM authors)) WHERE rn = 1
""")
def set07_first_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The first slug of each name."""
    a = table(spark, d, "authors").select("slug", "display_name").distinct()
    return records.best_per_key(a, ["display_name"], [F.col("slug")]).select("slug", "display_name")


@query("""
WITH w AS (SELECT DISTINCT author_slug FROM works WHERE author_slug IS NOT NULL), r AS (SELECT slug FROM authors WHERE withdrawn_at IS NOT NULL), b AS (SELECT slug FROM authors WHERE withdrawn_at IS NULL)
SELECT author_slug, author_slug IN (SELECT slug FROM r) AS withdrawn FROM w WHERE author_slug IN (SELECT slug FROM r) OR author_slug IN (SELECT slug FROM b)
""")
def set05_withdrawals_win(spark: SparkSession, d: str) -> DataFrame:
    """Authors in use: a withdrawn row of a slug beats its other rows."""
    a = table(spark, d, "authors").groupBy(F.col("slug").alias("author_slug")).agg(F.bool_or(F.col("withdrawn_at").isNotNull()).alias("withdrawn"))
    return table(spark, d, "works").where("author_slug is not null").select("author_slug").distinct().join(a, "author_slug")


@query("""
SELECT DISTINCT work_slug, array_to_string(list_sort(list_intersect(evidence, ['title', 'directory'])), ',') AS weak, list_has_any(evidence, ['series-index', 'nav_links']) AS strong FROM works WHERE evidence IS NOT NULL
""")
def set06_evidence_sets(spark: SparkSession, d: str) -> DataFrame:
    """Weak and strong evidence of works."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    e = table(spark, d, "works").where("evidence is not null")
    return e.select("work_slug", F.array_join(F.array_sort(F.array_intersect("evidence", arr("title", "directory"))), ",").alias("weak"), F.arrays_overlap("evidence", arr("series-index", "nav_links")).alias("strong")).distinct()


@query("""
SELECT t AS table_name, count(*) AS n FROM (SELECT 'episodes' AS t FROM episodes UNION ALL SELECT 'works' FROM works UNION ALL SELECT 'authors' FROM authors UNION ALL SELECT 'terms' FROM terms) GROUP BY t
""")
def set01_union_of_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the catalogue's tables."""
    from functools import reduce

    names = ["episodes", "works", "authors", "terms"]
    return reduce(DataFrame.unionByName, [table(spark, d, n).select(F.lit(n).alias("table_name")) for n in names]).groupBy("table_name").agg(F.count("*").alias("n"))


@query("""
SELECT entry_no, md5(coalesce(title, '')) AS md5, sha256(coalesce(title, '')) AS sha256, substr(strftime(to_timestamp(entry_no * 100000), '%Y-%m-%d'), 1, 10) AS day FROM episodes
""")
def f35_hashes_and_days(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of titles and the UTC day of a count of seconds, its first ten characters, for any count."""
    t = F.coalesce("title", F.lit(""))
    # 15,778,476 counts of 100,000 s are 50,000 years of the calendar: whole turns add to the year, the rest is a date; no timestamp, whose range ends at 92,233,720 counts
    turns = F.expr("entry_no div 15778476 - if(entry_no % 15778476 < 0, 1, 0)")
    date = F.date_from_unix_date(F.expr("pmod(entry_no, 15778476) * 125 div 108").cast("int"))
    year = F.year(date) + turns * 50_000
    written = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    day = F.substring(F.concat(written, F.substring(date.cast("string"), -6, 6)), 1, 10)
    return table(spark, d, "episodes").select("entry_no", F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), day.alias("day"))


@query("""
SELECT DISTINCT slug, trim(regexp_replace(lower(slug), '[^a-z0-9]+', '-', 'g'), '-') AS made, regexp_matches(slug, '^[a-z]+$') AS one_word FROM authors
""")
def f40_slugs(spark: SparkSession, d: str) -> DataFrame:
    """ASCII slugs of stored slugs."""
    return table(spark, d, "authors").select("slug", text.slugify(F.col("slug")).alias("made"), F.col("slug").rlike("^[a-z]+$").alias("one_word")).distinct()


@query("""
SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) AS n_clean, length(text) AS n FROM documents WHERE text IS NOT NULL
""")
def f51_control_free(spark: SparkSession, d: str) -> DataFrame:
    """Lengths without control characters."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(text.control_free(F.col("text"))).cast("long").alias("n_clean"), F.length("text").cast("long").alias("n"))


@query("""
WITH y AS (SELECT entry_no, try_cast(regexp_extract(date, '^(\\d{4})-\\d{2}-\\d{2}$', 1) AS INTEGER) AS year, date FROM episodes)
SELECT year, entry_no FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY date, entry_no) AS rn FROM y WHERE year >= 1990) WHERE rn <= 60
""")
def qry04_year_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every year of the timeline."""
    y = F.regexp_extract("date", r"^(\d{4})-\d{2}-\d{2}$", 1).try_cast("int")
    e = table(spark, d, "episodes").select("entry_no", "date", y.alias("year")).where("year >= 1990")
    return records.ranked(e, ["year"], [F.col("date"), F.col("entry_no")], "rn").where("rn <= 60").select("year", "entry_no")


@query("""
SELECT work_slug, count(*) AS members, string_agg(title, '|' ORDER BY ordinal, episode_id) AS contents FROM (
  SELECT DISTINCT work_slug, x.ordinal AS ordinal, x.episode_id AS episode_id, coalesce(x.title, '') AS title FROM (SELECT work_slug, unnest(episodes) AS x FROM works)) GROUP BY work_slug
""")
def qry08_contents(spark: SparkSession, d: str) -> DataFrame:
    """Table of contents of each work."""
    w = table(spark, d, "works").select("work_slug", F.explode("episodes").alias("x")).select("work_slug", "x.ordinal", "x.episode_id", F.coalesce("x.title", F.lit("")).alias("title")).distinct()
    toc = F.array_sort(F.collect_list(F.struct("ordinal", "episode_id", "title")))
    return w.groupBy("work_slug").agg(F.count("*").alias("members"), F.array_join(F.transform(toc, lambda x: x["title"]), "|").alias("contents"))
