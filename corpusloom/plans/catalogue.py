"""Queries of the catalogue operators, each over whole tables, with the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import markup, text, urls
from corpusloom.operators import graph, records
from corpusloom.operators.bounded import checkpointed
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


def _ids(column: str, name: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name)


# ---- captures: events play the part of capture logs


@query("""
WITH c AS (SELECT *, CASE WHEN value > 0 AND value <= 10 THEN 0 ELSE 1 END AS q FROM events WHERE event_type <> 'error')
SELECT user_id, event_id, q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY q DESC, ts DESC, event_id) AS rn FROM c) WHERE rn = 1
""")
def agg03_best_capture(spark: SparkSession, d: str) -> DataFrame:
    """Best capture of each key: quality first, then the newest; ties by id."""
    c = table(spark, d, "events").where("event_type <> 'error'").withColumn("q", F.when((F.col("value") > 0) & (F.col("value") <= 10), 0).otherwise(1))
    best = F.max_by(F.struct("event_id", "q"), F.struct("q", "ts", -F.col("event_id")))
    return c.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.q")


@query("""
SELECT user_id, event_type, event_id, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 3
""")
def win02_first_events(spark: SparkSession, d: str) -> DataFrame:
    """The first three events of each user and type."""
    r = records.ranked(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "rn")
    return r.where("rn <= 3").select("user_id", "event_type", "event_id", "rn")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_hour FROM events
""")
def win13_events_last_hour(spark: SparkSession, d: str) -> DataFrame:
    """Events of the same user within the hour before each event."""
    s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("_s").rangeBetween(-3600, 0)
    return table(spark, d, "events").withColumn("_s", s).select("event_id", F.count("*").over(w).alias("n_hour"))


@query("""
SELECT coalesce(json_extract_string(props, '$.k'), '-') AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1
""")
def f50_json_field(spark: SparkSession, d: str) -> DataFrame:
    """Events by a field of their JSON."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("-"))
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# ---- joins


@query("""
SELECT DISTINCT d.episode_id FROM documents d WHERE d.episode_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM episodes e WHERE e.episode_id = d.episode_id)
""")
def join01_documents_without_episode(spark: SparkSession, d: str) -> DataFrame:
    """Episode ids of documents that the catalogue lacks."""
    docs = table(spark, d, "documents").select("episode_id").where("episode_id is not null").distinct()
    return docs.join(table(spark, d, "episodes").select("episode_id"), "episode_id", "left_anti")


@query("""
SELECT e.entry_no, e.episode_id FROM episodes e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.episode_id = e.episode_id AND d.kind = 'body')
""")
def join21_episodes_with_body(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue lines with a body."""
    bodies = table(spark, d, "documents").where("kind = 'body'").select("episode_id")
    return table(spark, d, "episodes").select("entry_no", "episode_id").join(bodies, "episode_id", "left_semi").select("entry_no", "episode_id")


@query("""
SELECT p_size, min(p_partkey) AS part, count(*) AS n FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1
""")
def join06_group_filter(spark: SparkSession, d: str) -> DataFrame:
    """Groups kept by a condition on their distinct values."""
    g = table(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("part"), F.count("*").alias("n"), F.count_distinct("p_brand").alias("_b"))
    return g.where("_b > 1").drop("_b")


@query("""
WITH g AS (SELECT regexp_extract(source_path, '([^/]*)$', 1) AS bn, min(source_path) AS donor FROM episodes WHERE source_path IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT coalesce(size_kb, -1)) = 1)
SELECT e.entry_no, g.donor FROM episodes e JOIN g ON regexp_extract(e.source_path, '([^/]*)$', 1) = g.bn WHERE e.source_path <> g.donor
""")
def join06_unique_basename_donor(spark: SparkSession, d: str) -> DataFrame:
    """Files that take a donor of the same name, where all of that name agree in size."""
    e = table(spark, d, "episodes").where("source_path is not null").select("entry_no", "source_path", "size_kb").withColumn("bn", urls.basename(F.col("source_path")))
    g = e.groupBy("bn").agg(F.min("source_path").alias("donor"), F.count_distinct(F.coalesce("size_kb", F.lit(-1))).alias("_n")).where("_n = 1")
    return e.join(g, "bn").where("source_path <> donor").select("entry_no", "donor")


_ALIAS = "SELECT taxonomy, slug, a FROM (SELECT taxonomy, slug, unnest(list_concat([slug, name], coalesce(lookup_variants, []))) AS a FROM vocabulary) WHERE a IS NOT NULL GROUP BY ALL"


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary")
    forms = F.concat(F.array("slug", "name"), F.coalesce("lookup_variants", F.array().cast("array<string>")))
    return v.select("taxonomy", "slug", F.explode(forms).alias("a")).where("a is not null").distinct()


@query(f"""
WITH al AS ({_ALIAS}), t AS (SELECT term_no, taxonomy, unnest(raw_variants) AS raw FROM terms)
SELECT t.term_no, t.taxonomy, t.raw, min(al.slug) AS slug FROM t LEFT JOIN al ON al.taxonomy = t.taxonomy AND al.a = t.raw WHERE t.raw IS NOT NULL GROUP BY ALL
""")
def join17_exact_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Typed values with the entry that has exactly that form, null where none has."""
    t = table(spark, d, "terms").select("term_no", "taxonomy", F.explode("raw_variants").alias("raw")).where("raw is not null")
    a = _aliases(spark, d).select(F.col("taxonomy").alias("_t"), "slug", "a")
    return t.join(a, (F.col("taxonomy") == F.col("_t")) & (F.col("raw") == F.col("a")), "left").groupBy("term_no", "taxonomy", "raw").agg(F.min("slug").alias("slug"))


@query("""
SELECT work_slug, episode_id, pos AS ordinal FROM (
  SELECT work_slug, unnest(list_transform(episodes, lambda x: x.episode_id)) AS episode_id, unnest(range(1, len(episodes) + 1)) AS pos FROM (SELECT DISTINCT work_slug, episodes FROM works))
""")
def join18_membership(spark: SparkSession, d: str) -> DataFrame:
    """Members of works with their place."""
    w = table(spark, d, "works").select("work_slug", "episodes").distinct()
    return w.select("work_slug", F.posexplode("episodes.episode_id").alias("_p", "episode_id")).select("work_slug", "episode_id", (F.col("_p") + 1).alias("ordinal"))


@query("""
WITH m AS (SELECT DISTINCT work_slug, x.episode_id AS episode_id FROM (SELECT work_slug, unnest(episodes) AS x FROM works)),
g AS (SELECT DISTINCT episode_id, genre FROM (SELECT episode_id, unnest(genre_raw) AS genre FROM episodes) WHERE genre IS NOT NULL)
SELECT DISTINCT work_slug, genre FROM m JOIN g USING (episode_id)
""")
def join19_inherited_genres(spark: SparkSession, d: str) -> DataFrame:
    """Genres that works take from their episodes."""
    m = table(spark, d, "works").select("work_slug", F.explode("episodes.episode_id").alias("episode_id")).distinct()
    g = table(spark, d, "episodes").select("episode_id", F.explode("genre_raw").alias("genre")).where("genre is not null").distinct()
    return m.join(g, "episode_id").select("work_slug", "genre").distinct()


@query("""
WITH o AS (SELECT work_slug AS old, x.episode_id AS e FROM (SELECT work_slug, unnest(episodes) AS x FROM works)),
n AS (SELECT x.episode_id AS e, min(work_slug) AS new FROM (SELECT work_slug, unnest(episodes) AS x FROM works) GROUP BY 1)
SELECT old, string_agg(DISTINCT new, ',' ORDER BY new) AS targets FROM o JOIN n USING (e) GROUP BY old HAVING count(DISTINCT new) > 1 OR min(new) <> old
""")
def join20_moved_works(spark: SparkSession, d: str) -> DataFrame:
    """Works whose episodes now belong to other works, after each episode went to its first work."""
    o = table(spark, d, "works").select(F.col("work_slug").alias("old"), F.explode("episodes.episode_id").alias("e"))
    n = o.groupBy("e").agg(F.min("old").alias("new"))
    return o.join(n, "e").groupBy("old").agg(F.collect_set("new").alias("t")).where(~((F.size("t") == 1) & (F.col("t")[0] == F.col("old")))).select("old", F.array_join(F.array_sort("t"), ",").alias("targets"))


@query("""
WITH a AS (SELECT DISTINCT slug, unnest(list_concat([display_name], coalesce(display_variants, []))) AS n FROM authors)
SELECT e.entry_no, min(a.slug) AS slug, count(DISTINCT a.slug) AS candidates FROM episodes e JOIN a ON e.author = a.n GROUP BY e.entry_no
""")
def join23_authors_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Authors by exact name or variant."""
    names = F.concat(F.array("display_name"), F.coalesce("display_variants", F.array().cast("array<string>")))
    a = table(spark, d, "authors").select("slug", F.explode(names).alias("author")).where("author is not null").distinct()
    e = table(spark, d, "episodes").select("entry_no", "author")
    return e.join(a, "author").groupBy("entry_no").agg(F.min("slug").alias("slug"), F.count_distinct("slug").alias("candidates"))


@query("""
WITH b AS (SELECT kansou_slug, min(slug) AS s, count(DISTINCT slug) AS n FROM authors WHERE kansou_slug IS NOT NULL GROUP BY 1),
nm AS (SELECT n, min(slug) AS s FROM (SELECT slug, unnest(list_concat([display_name], coalesce(display_variants, []))) AS n FROM authors) WHERE n IS NOT NULL GROUP BY n HAVING count(DISTINCT slug) = 1)
SELECT e.entry_no, coalesce(b.s, nm.s) AS slug, CASE WHEN b.s IS NOT NULL THEN 'board' WHEN nm.s IS NOT NULL THEN 'name' ELSE 'none' END AS route
FROM episodes e LEFT JOIN b ON e.kansou_slug = b.kansou_slug AND b.n = 1 LEFT JOIN nm ON e.author = nm.n
""")
def join15_author_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Author of each line: by a board of one author, else by a name of one author."""
    a = table(spark, d, "authors")
    b = a.where("kansou_slug is not null").groupBy("kansou_slug").agg(F.min("slug").alias("_b"), F.count_distinct("slug").alias("_n")).where("_n = 1").drop("_n")
    names = F.concat(F.array("display_name"), F.coalesce("display_variants", F.array().cast("array<string>")))
    n = a.select("slug", F.explode(names).alias("author")).where("author is not null").groupBy("author").agg(F.min("slug").alias("_a"), F.count_distinct("slug").alias("_n")).where("_n = 1").drop("_n")
    e = table(spark, d, "episodes").select("entry_no", "kansou_slug", "author").join(b, "kansou_slug", "left").join(n, "author", "left")
    return e.select("entry_no", F.coalesce("_b", "_a").alias("slug"), F.when(F.col("_b").isNotNull(), "board").when(F.col("_a").isNotNull(), "name").otherwise("none").alias("route"))


@query(f"""
WITH al AS ({_ALIAS}), typed AS (SELECT DISTINCT taxonomy, r FROM (SELECT taxonomy, unnest(raw_variants) AS r FROM terms) WHERE r IS NOT NULL)
SELECT coalesce(al.taxonomy, typed.taxonomy) AS taxonomy, CASE WHEN typed.r IS NULL THEN 'unused' ELSE 'unknown' END AS side, coalesce(al.a, typed.r) AS form
FROM al FULL JOIN typed ON al.taxonomy = typed.taxonomy AND al.a = typed.r WHERE al.a IS NULL OR typed.r IS NULL
""")
def join27_vocabulary_difference(spark: SparkSession, d: str) -> DataFrame:
    """Forms that only the vocabulary or only the typed values have."""
    a = _aliases(spark, d).select("taxonomy", F.col("a").alias("form")).distinct().withColumn("_a", F.lit(1))
    t = table(spark, d, "terms").select("taxonomy", F.explode("raw_variants").alias("form")).where("form is not null").distinct().withColumn("_t", F.lit(1))
    return a.join(t, ["taxonomy", "form"], "full_outer").where("_a is null or _t is null").select("taxonomy", F.when(F.col("_t").isNull(), "unused").otherwise("unknown").alias("side"), "form")


@query("""
WITH w AS (SELECT DISTINCT source_path AS p FROM episodes WHERE withdrawn_at IS NOT NULL AND source_path IS NOT NULL),
r AS (SELECT DISTINCT regexp_extract(p, '^(.*/)[^/]*$', 1) || '*' AS rule, regexp_extract(p, '^(.*/)[^/]*$', 1) AS stem, true AS open FROM w WHERE ends_with(p, '1.html') AND contains(p, '/') UNION SELECT p, p, false FROM w)
SELECT source_path, rule FROM (SELECT e.source_path, r.rule, row_number() OVER (PARTITION BY e.source_path ORDER BY length(r.stem) DESC, r.rule) AS rn
  FROM (SELECT DISTINCT source_path FROM episodes WHERE source_path IS NOT NULL) e JOIN r ON CASE WHEN r.open THEN starts_with(e.source_path, r.stem) ELSE e.source_path = r.stem OR starts_with(e.source_path, r.stem || '/') END) WHERE rn = 1
""")
def join31_prefix_rules(spark: SparkSession, d: str) -> DataFrame:
    """Paths denied with the rule that denies them: a path of its own or the beginning of many, the longest counting."""
    e = table(spark, d, "episodes").where("source_path is not null")
    w = e.where("withdrawn_at is not null").select("source_path").distinct()
    rules = w.where("source_path like '%1.html' and source_path like '%/%'").select(F.concat(F.regexp_extract("source_path", "^(.*/)[^/]*$", 1), F.lit("*")).alias("rule")).unionByName(w.select(F.col("source_path").alias("rule"))).distinct()
    return records.prefix_matches(e.select("source_path").distinct(), "source_path", rules, "rule")


#: Rules of shared worlds: (world, board, beginning of the path, pattern of the title).
_WORLDS = [("lighthouse", "tourou_jima", "novel/2008", "灯台|灯火"), ("clock", "tokei", "novel/199", "時計"), ("spring", "haru", "external/", "^春")]


@query(f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(str(w) for w in _WORLDS)}) t(world, board, prefix, pattern))
SELECT e.entry_no, r.world, coalesce(e.kansou_slug = r.board, false) AS by_board, coalesce(starts_with(e.source_path, r.prefix), false) AS by_path, coalesce(regexp_matches(e.title, r.pattern), false) AS by_title
FROM episodes e, r WHERE coalesce(e.kansou_slug = r.board, false) OR coalesce(starts_with(e.source_path, r.prefix), false) OR coalesce(regexp_matches(e.title, r.pattern), false)
""")
def join34_world_rules(spark: SparkSession, d: str) -> DataFrame:
    """Lines of shared worlds by board, path or title, for each rule of a fixed list."""
    no = F.lit(False)
    rows = [F.struct(F.lit(w).alias("world"), F.coalesce(F.col("kansou_slug") == b, no).alias("by_board"), F.coalesce(F.col("source_path").startswith(p), no).alias("by_path"), F.coalesce(F.col("title").rlike(t), no).alias("by_title")) for w, b, p, t in _WORLDS]
    e = table(spark, d, "episodes").select("entry_no", F.explode(F.array(*rows)).alias("r")).select("entry_no", "r.*")
    return e.where("by_board or by_path or by_title")


@query("""
WITH RECURSIVE ed AS (
  SELECT DISTINCT 'a:' || author_slug AS p, 'w:' || work_slug AS c FROM works WHERE author_slug IS NOT NULL
  UNION SELECT DISTINCT 'w:' || work_slug, 'e:' || x.episode_id FROM (SELECT work_slug, unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL
  UNION SELECT DISTINCT 'e:' || episode_id, 'd:' || doc_id FROM documents WHERE episode_id IS NOT NULL),
t AS (SELECT DISTINCT 'a:' || author_slug AS node, 0 AS depth FROM works WHERE author_slug IS NOT NULL
  UNION SELECT ed.c, t.depth + 1 FROM t JOIN ed ON ed.p = t.node)
SELECT node, min(depth) AS depth FROM t GROUP BY node
""")
def join29_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Everything below the authors: works, episodes, documents."""
    w = table(spark, d, "works")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ed = (
        w.where("author_slug is not null").select(tag("a:", "author_slug").alias("parent"), tag("w:", "work_slug").alias("child"))
        .unionByName(w.select("work_slug", F.explode("episodes.episode_id").alias("e")).where("e is not null").select(tag("w:", "work_slug").alias("parent"), tag("e:", "e").alias("child")))
        .unionByName(table(spark, d, "documents").where("episode_id is not null").select(tag("e:", "episode_id").alias("parent"), tag("d:", "doc_id").alias("child")))
        .distinct()
    )
    # one sweep with a single root mark keeps each node once
    roots = w.where("author_slug is not null").select(tag("a:", "author_slug").alias("child")).distinct().select(F.lit("*").alias("parent"), "child")
    found = graph.descendants(ed.unionByName(roots), spark.createDataFrame([("*",)], "node string"))
    return found.where("node <> '*'").groupBy("node").agg((F.min("depth") - 1).alias("depth"))


@query("""
WITH e AS (SELECT entry_no, episode_id, withdrawn_at FROM episodes)
SELECT p.entry_no AS parent, count(c.doc_id) AS children FROM e p LEFT JOIN documents c ON c.episode_id = p.episode_id WHERE p.withdrawn_at IS NOT NULL GROUP BY 1
""")
def join32_denied_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents under withdrawn episodes."""
    p = table(spark, d, "episodes").where("withdrawn_at is not null").select(F.col("entry_no").alias("parent"), "episode_id")
    c = table(spark, d, "documents").select("episode_id", "doc_id")
    return p.join(c, "episode_id", "left").groupBy("parent").agg(F.count("doc_id").alias("children"))


# ---- aggregates


@query("""
WITH l AS (SELECT x.episode_id AS target, work_slug AS src FROM (SELECT work_slug, unnest(episodes) AS x FROM works)),
m AS (SELECT * FROM l WHERE target IS NOT NULL AND target NOT IN (SELECT episode_id FROM episodes WHERE episode_id IS NOT NULL))
SELECT target, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(src))), 1, 3), ',') AS first_sources FROM m GROUP BY target
""")
def agg01_missing_targets(spark: SparkSession, d: str) -> DataFrame:
    """Missing targets with their count and first three referrers."""
    links = table(spark, d, "works").select(F.explode("episodes.episode_id").alias("target"), F.col("work_slug").alias("src")).where("target is not null")
    missing = links.join(table(spark, d, "episodes").select(F.col("episode_id").alias("target")).distinct(), "target", "left_anti")
    return missing.groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("src")), 1, 3), ",").alias("first_sources"))


@query("SELECT split_part(source_path, '/', 2) AS part, count(*) AS n FROM episodes WHERE source_path IS NOT NULL GROUP BY 1 ORDER BY n DESC, part LIMIT 20")
def agg04_top_segments(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest second path parts."""
    p = F.split_part(F.col("source_path"), F.lit("/"), F.lit(2))
    return table(spark, d, "episodes").where("source_path is not null").groupBy(p.alias("part")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(20)


@query("""
SELECT count(*) AS episodes, count(DISTINCT episode_id) AS ids, count(title) AS titled, count(author) AS credited, count(kansou_slug) AS with_board,
  count(*) FILTER (size_kb IS NULL) AS no_size, count(*) FILTER (source_anchor IS NOT NULL) AS anchored, count(DISTINCT kansou_slug) AS boards,
  count(*) FILTER (entry_role = 'work') AS works, count(*) FILTER (withdrawn_at IS NOT NULL) AS withdrawn, coalesce(sum(size_kb), 0)::BIGINT AS kb,
  round(100.0 * count(author) / count(*), 2) AS credited_pct FROM episodes
""")
def agg05_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the catalogue in one row."""
    c = F.count_if
    return table(spark, d, "episodes").agg(
        F.count("*").alias("episodes"), F.count_distinct("episode_id").alias("ids"), F.count("title").alias("titled"), F.count("author").alias("credited"),
        F.count("kansou_slug").alias("with_board"), c(F.col("size_kb").isNull()).alias("no_size"), c(F.col("source_anchor").isNotNull()).alias("anchored"),
        F.count_distinct("kansou_slug").alias("boards"), c(F.col("entry_role") == "work").alias("works"), c(F.col("withdrawn_at").isNotNull()).alias("withdrawn"),
        F.coalesce(F.sum("size_kb"), F.lit(0)).alias("kb"), F.round(100.0 * F.count("author") / F.count("*"), 2).alias("credited_pct"),
    )


@query("""
SELECT coalesce(regexp_extract(date, '^(\\d{4})-', 1), '') AS year, coalesce(entry_type, '-') AS entry_type, coalesce(route, '-') AS route, count(*) AS n
FROM episodes GROUP BY 1, 2, 3
""")
def agg06_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Lines by year, type and route."""
    y = F.coalesce(F.regexp_extract("date", r"^(\d{4})-", 1), F.lit(""))
    return table(spark, d, "episodes").groupBy(y.alias("year"), F.coalesce("entry_type", F.lit("-")).alias("entry_type"), F.coalesce("route", F.lit("-")).alias("route")).agg(F.count("*").alias("n"))


@query("SELECT episode_id, count(*) AS n, min(entry_no) AS first_entry FROM episodes GROUP BY 1 HAVING count(*) > 1")
def agg08_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ids with several lines."""
    return table(spark, d, "episodes").groupBy("episode_id").agg(F.count("*").alias("n"), F.min("entry_no").alias("first_entry")).where("n > 1")


@query("""
WITH a AS (SELECT regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS dir, author, count(*) AS n FROM episodes WHERE author IS NOT NULL AND source_path IS NOT NULL GROUP BY ALL),
b AS (SELECT dir, author, n, row_number() OVER (PARTITION BY dir ORDER BY n DESC, author) AS rn, count(*) OVER (PARTITION BY dir) AS k FROM a),
m AS (SELECT dir, author, CASE WHEN k = 1 THEN 'dir-author' ELSE 'dir-author-majority' END AS how FROM b WHERE rn = 1 AND dir <> ''),
e AS (SELECT entry_no, string_split(regexp_extract(source_path, '^(.*)/[^/]*$', 1), '/') AS parts FROM episodes WHERE author IS NULL AND source_path IS NOT NULL),
x AS (SELECT entry_no, unnest(range(1, len(parts) + 1)) AS k, parts FROM e)
SELECT entry_no, author, how, depth FROM (SELECT x.entry_no, m.author, m.how, len(x.parts) - x.k AS depth, row_number() OVER (PARTITION BY x.entry_no ORDER BY x.k DESC) AS rn FROM x JOIN m ON m.dir = array_to_string(x.parts[1:x.k], '/')) WHERE rn = 1
""")
def agg11_directory_author(spark: SparkSession, d: str) -> DataFrame:
    """Author of uncredited lines from the nearest directory above with known ones: its only author or its majority."""
    e = table(spark, d, "episodes").where("source_path is not null").select("entry_no", "author", "source_path", urls.dirname(F.col("source_path")).alias("dir"))
    n = e.where("author is not null and dir <> ''").groupBy("dir", "author").agg(F.count("*").alias("n"))
    m = n.groupBy("dir").agg(F.min(F.struct(-F.col("n"), "author"))["author"].alias("_a"), F.when(F.count("*") == 1, "dir-author").otherwise("dir-author-majority").alias("how"))
    up = e.where("author is null").select("entry_no", F.posexplode(urls.ancestors(F.col("source_path"))).alias("depth", "dir"))
    near = up.join(m, "dir").groupBy("entry_no").agg(F.min(F.struct("depth", F.col("_a").alias("author"), "how")).alias("m"))
    return near.select("entry_no", "m.author", "m.how", F.col("m.depth").cast("long").alias("depth"))


@query("""
SELECT count(*) AS files, count(*) FILTER (c) AS already, count(*) FILTER (NOT c AND NOT x) AS added, count(*) FILTER (NOT c AND x) AS excluded,
  count(*) - count(*) FILTER (c) - count(*) FILTER (NOT c AND NOT x) - count(*) FILTER (NOT c AND x) AS remainder
FROM (SELECT coalesce(episode_id IN (SELECT episode_id FROM episodes WHERE episode_id IS NOT NULL), false) AS c, coalesce(replace(text, ' ', '') = '', true) OR coalesce(kind = 'notice', false) AS x FROM documents)
""")
def agg13_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Files are already catalogued, added or excluded; nothing remains."""
    e = table(spark, d, "episodes").select("episode_id").where("episode_id is not null").distinct().withColumn("_c", F.lit(True))
    x = F.coalesce(F.replace("text", F.lit(" "), F.lit("")) == "", F.lit(True)) | F.coalesce(F.col("kind") == "notice", F.lit(False))
    f = table(spark, d, "documents").join(e, "episode_id", "left").select(F.coalesce("_c", F.lit(False)).alias("c"), x.alias("x"))
    g = f.agg(F.count("*").alias("files"), F.count_if("c").alias("already"), F.count_if(~F.col("c") & ~F.col("x")).alias("added"), F.count_if(~F.col("c") & F.col("x")).alias("excluded"))
    return g.withColumn("remainder", F.expr("files - already - added - excluded"))


@query("""
WITH e AS (SELECT author, kansou_slug, corpus, date, count(*) OVER () AS _ FROM episodes WHERE author IS NOT NULL)
SELECT author, count(*) AS episodes, min(date) FILTER (regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')) AS first_day, max(date) FILTER (regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')) AS last_day,
  coalesce(string_agg(DISTINCT kansou_slug, ',' ORDER BY kansou_slug), '') AS boards FROM e GROUP BY author
""")
def agg18_author_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What each name wrote: lines, first and last day, boards."""
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date"))
    return table(spark, d, "episodes").where("author is not null").groupBy("author").agg(F.count("*").alias("episodes"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), _ids("kansou_slug", "boards"))


@query("""
WITH t AS (SELECT unnest(genre_raw) AS term FROM episodes), c AS (SELECT term, count(*) AS freq FROM t WHERE term IS NOT NULL GROUP BY term)
SELECT term, freq, freq >= 10 AS core, round(100.0 * freq / sum(freq) OVER (), 4) AS pct FROM c
""")
def agg19_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of typed genres, core from ten on, and share of all."""
    c = table(spark, d, "episodes").select(F.explode("genre_raw").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("freq"))
    total = c.agg(F.sum("freq")).scalar()
    return c.select("term", "freq", (F.col("freq") >= 10).alias("core"), F.round(100.0 * F.col("freq") / total, 4).alias("pct"))


@query("SELECT e AS evidence, count(DISTINCT work_slug) AS works FROM (SELECT work_slug, unnest(evidence) AS e FROM works) WHERE e IS NOT NULL GROUP BY e")
def agg20_works_per_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Distinct works by kind of evidence."""
    return table(spark, d, "works").select("work_slug", F.explode("evidence").alias("evidence")).where("evidence is not null").groupBy("evidence").agg(F.count_distinct("work_slug").alias("works"))


@query("SELECT year(built_at)::INTEGER AS year, count(DISTINCT work_slug) AS works FROM works WHERE built_at IS NOT NULL AND year(built_at) >= 1990 GROUP BY 1")
def agg21_works_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Works by year of building, from 1990 on."""
    return table(spark, d, "works").where("built_at is not null").groupBy(F.year("built_at").alias("year")).agg(F.count_distinct("work_slug").alias("works")).where("year >= 1990")


_FIELDS = ["title", "author", "kansou_slug", "date_raw", "date", "catalog_ref", "route"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NOT NULL AND {c} <> '') AS filled, round(100.0 * count(*) FILTER ({c} IS NOT NULL AND {c} <> '') / count(*), 2) AS pct FROM episodes" for c in _FIELDS))
def agg24_field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many lines have each field, in one pass."""
    e = table(spark, d, "episodes").agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(F.col(c) != "", F.lit(False))).alias(c) for c in _FIELDS])
    rows = e.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in _FIELDS])).alias("r"))
    return rows.select("r.field", "r.filled", F.round(100.0 * F.col("r.filled") / F.col("_n"), 2).alias("pct"))


@query("""
SELECT source, count(*) AS docs, count(*) FILTER (text IS NULL) AS nulls, count(*) FILTER (replace(text, ' ', '') = '') AS blank, coalesce(sum(n_chars), 0)::BIGINT AS chars,
  CASE WHEN max(n_chars) >= 10000 THEN 'long' WHEN max(n_chars) >= 1000 THEN 'medium' ELSE 'short' END AS bucket FROM documents GROUP BY source
""")
def agg12_source_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, with empty ones and size buckets."""
    m = F.max("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(F.replace("text", F.lit(" "), F.lit("")) == "").alias("blank"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"),
        F.when(m >= 10000, "long").when(m >= 1000, "medium").otherwise("short").alias("bucket"),
    )


# ---- windows


@query("""
SELECT entry_no, episode_id || CASE WHEN count(*) OVER (PARTITION BY source_path, source_anchor) > 1 THEN '+' || coalesce(date, '') ELSE '' END AS key,
  count(*) OVER (PARTITION BY source_path) AS shared_by FROM episodes
""")
def win06_collision_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a colliding place gets its day in the key; lines per file beside it."""
    e = table(spark, d, "episodes").select("entry_no", "episode_id", "source_path", "source_anchor", "date")
    k = records.collision_suffix(e, ["source_path", "source_anchor"], F.col("episode_id"), F.col("date"), "key")
    n = e.groupBy(F.col("source_path").alias("_p")).agg(F.count("*").alias("shared_by"))
    return k.join(n, k["source_path"].eqNullSafe(n["_p"])).select("entry_no", "key", "shared_by")


@query("""
WITH e AS (SELECT kansou_slug, entry_no, author, row_number() OVER (PARTITION BY kansou_slug ORDER BY entry_no) AS n FROM episodes WHERE kansou_slug IS NOT NULL),
h AS (SELECT *, max(CASE WHEN author IS NOT NULL THEN n END) OVER (PARTITION BY kansou_slug ORDER BY n) AS hn FROM e)
SELECT h.entry_no, CASE WHEN h.n - h.hn < 2 THEN x.author END AS author_carried FROM h LEFT JOIN e x ON x.kansou_slug = h.kansou_slug AND x.n = h.hn
""")
def win03_carried_author(spark: SparkSession, d: str) -> DataFrame:
    """Author carried down to the next line of a board, no further."""
    e = table(spark, d, "episodes").where("kansou_slug is not null").select("kansou_slug", "entry_no", "author").withColumn("span", F.lit(2))
    return records.carried(e, ["kansou_slug"], [F.col("entry_no")], "author", "span").select("entry_no", "author_carried")


@query("""
SELECT entry_no, first(author IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY entry_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS author_filled,
  author IS NULL AS inherited FROM (SELECT * FROM episodes WHERE source_path IS NOT NULL)
""")
def win08_backfilled_author(spark: SparkSession, d: str) -> DataFrame:
    """Author filled back from later lines of the file."""
    e = table(spark, d, "episodes").where("source_path is not null").select("source_path", "entry_no", "author")
    return records.filled_back(e, ["source_path"], [F.col("entry_no")], "author").select("entry_no", "author_filled", F.col("author").isNull().alias("inherited"))


@query("""
WITH b AS (SELECT entry_no, regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '\\.[a-z]+$', '') AS base, coalesce(entry_role = 'work', false) AS sure FROM episodes WHERE source_path IS NOT NULL),
k AS (SELECT DISTINCT regexp_extract(base, '^(.*)-(\\d+)$', 1) AS b, TRY_CAST(regexp_extract(base, '^(.*)-(\\d+)$', 2) AS INTEGER) AS k FROM b),
t AS (SELECT b, list_sort(list(k)) AS taken FROM k WHERE b <> '' AND k >= 2 GROUP BY b),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY sure DESC, entry_no) AS n FROM b)
SELECT entry_no, CASE WHEN n = 1 THEN base ELSE base || '-' || list_reduce(list_prepend(n, coalesce(taken, [])), lambda a, x: CASE WHEN a >= 2 AND x <= a THEN a + 1 ELSE a END) END AS slug
FROM r LEFT JOIN t ON r.base = t.b
""")
def win09_unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Unique slugs from file names, confirmed roles first."""
    base = F.regexp_replace(urls.basename(F.col("source_path")), r"\.[a-z]+$", "")
    e = table(spark, d, "episodes").where("source_path is not null").select("entry_no", base.alias("base"), F.coalesce(F.col("entry_role") == "work", F.lit(False)).alias("sure"))
    return records.unique_slugs(e, "base", ["entry_no"], "sure").select("entry_no", "slug")


@query("""
SELECT entry_no, first_value(entry_no) OVER w AS canonical, row_number() OVER w > 1 AS superseded FROM episodes
WINDOW w AS (PARTITION BY episode_id ORDER BY date DESC NULLS LAST, CASE corpus WHEN 'honkan' THEN 3 WHEN 'uncatalogued' THEN 2 WHEN 'legacy' THEN 1 ELSE 0 END DESC, coalesce(size_kb, -1) DESC, entry_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def win12_canonical_version(spark: SparkSession, d: str) -> DataFrame:
    """Canonical line of each id: the newest date, then by corpus, size and number."""
    p = F.when(F.col("corpus") == "honkan", 3).when(F.col("corpus") == "uncatalogued", 2).when(F.col("corpus") == "legacy", 1).otherwise(0)
    w = Window.partitionBy("episode_id").orderBy(F.col("date").desc_nulls_last(), F.desc("_p"), F.coalesce("size_kb", F.lit(-1)).desc(), "entry_no")
    e = table(spark, d, "episodes").withColumn("_p", p)
    return e.select("entry_no", F.first("entry_no").over(w).alias("canonical"), (F.row_number().over(w) > 1).alias("superseded"))


# ---- order, sets


@query("""
SELECT g, n, row_number() OVER (ORDER BY CASE WHEN list_position(['あ行','か行','さ行','た行','な行','は行','ま行','や行','ら行','わ行'], g) > 0
  THEN list_position(['あ行','か行','さ行','た行','な行','は行','ま行','や行','ら行','わ行'], g) WHEN g = '他' THEN 99 ELSE 50 END, g) AS place
FROM (SELECT coalesce(yomi_group, '他') AS g, count(DISTINCT slug) AS n FROM authors GROUP BY 1)
""")
def srt05_kana_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the author index in kana order, others last."""
    rows = ["あ行", "か行", "さ行", "た行", "な行", "は行", "ま行", "や行", "ら行", "わ行"]
    g = table(spark, d, "authors").groupBy(F.coalesce("yomi_group", F.lit("他")).alias("g")).agg(F.count_distinct("slug").alias("n"))
    at = F.array_position(F.array(*[F.lit(r) for r in rows]), F.col("g"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).when(F.col("g") == "他", 99).otherwise(50), "g")))


@query("SELECT entry_no, date FROM episodes WHERE date IS NOT NULL ORDER BY date, entry_no LIMIT 60 OFFSET 60")
def srt06_second_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the listing by date."""
    return table(spark, d, "episodes").where("date is not null").select("entry_no", "date").orderBy("date", "entry_no").offset(60).limit(60)


@query("""
WITH w AS (SELECT work_slug, row_number() OVER (ORDER BY work_slug) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT work_slug FROM works))
SELECT h::INTEGER AS hour, work_slug FROM (SELECT unnest(range(0, 24)) AS h) JOIN w ON w.i = (((2025010100 + h) * 2654435761) % 2147483647) % w.n
""")
def srt09_hourly_pick(spark: SparkSession, d: str) -> DataFrame:
    """A fixed pick for each hour of a day."""
    ordered, n = records.numbered(table(spark, d, "works").select("work_slug").distinct(), ["work_slug"], "i")
    picks = spark.range(24).select(F.col("id").cast("int").alias("hour"), (((F.col("id") + 2025010100) * F.lit(2654435761)) % 2147483647 % max(n, 1)).alias("i"))
    return ordered.join(F.broadcast(picks), "i").select("hour", "work_slug")


@query("SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY md5('20260830|' || doc_id), doc_id LIMIT 100")
def srt10_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents by a seeded hash, whatever the order of the input."""
    return table(spark, d, "documents").select("doc_id").distinct().orderBy(F.md5(F.concat(F.lit("20260830|"), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("""
SELECT 'only_authors' AS side, count(*) AS n FROM (SELECT slug FROM authors EXCEPT SELECT author_slug FROM works)
UNION ALL SELECT 'only_works', count(*) FROM (SELECT author_slug FROM works WHERE author_slug IS NOT NULL EXCEPT SELECT slug FROM authors)
UNION ALL SELECT 'both', count(*) FROM (SELECT slug FROM authors INTERSECT SELECT author_slug FROM works)
UNION ALL SELECT 'either', count(*) FROM (SELECT slug FROM authors UNION SELECT author_slug FROM works WHERE author_slug IS NOT NULL)
""")
def set04_slug_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the sets of slugs of authors and works."""
    a, w = table(spark, d, "authors").select("slug"), table(spark, d, "works").where("author_slug is not null").select(F.col("author_slug").alias("slug"))
    one = lambda side, df: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return one("only_authors", a.subtract(w)).unionByName(one("only_works", w.subtract(a))).unionByName(one("both", a.intersect(w))).unionByName(one("either", a.union(w).distinct()))


@query("SELECT corpus, count(*) AS n FROM (SELECT corpus FROM episodes WHERE corpus IS DISTINCT FROM 'legacy' UNION ALL SELECT 'legacy' FROM works) GROUP BY corpus")
def set02_replaced_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after one corpus was replaced."""
    added = table(spark, d, "works").select(F.lit("legacy").alias("corpus"))
    return records.replaced(table(spark, d, "episodes").select("corpus", "entry_no"), added, "corpus", "legacy").groupBy("corpus").agg(F.count("*").alias("n"))


# ---- functions


@query("""
SELECT doc_id, md5(text) AS md5, regexp_replace(text, '<[^>]+>', '', 'g') AS stripped, length(regexp_replace(text, '<[^>]+>', '', 'g')) AS n FROM documents WHERE text IS NOT NULL
""")
def f01_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """Texts without tags, with hash and length."""
    s = text.strip_tags(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("md5"), s.alias("stripped"), F.length(s).alias("n"))


@query("SELECT entry_no, array_to_string(list_filter(regexp_split_to_array(title, '[\\s　]+'), lambda x: x <> ''), '|') AS tokens FROM episodes WHERE title IS NOT NULL")
def f13_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Titles in tokens."""
    return table(spark, d, "episodes").where("title is not null").select("entry_no", F.array_join(text.split_tokens(F.col("title")), "|").alias("tokens"))


@query("""
WITH a AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'),
  lambda x: NOT regexp_matches(lower(x), '\\.(html?|cgi|jpg|gif|png)$') AND NOT regexp_matches(lower(x), 'hoge|example|localhost|virtual\\.domain')) AS found, text FROM documents)
SELECT doc_id, len(found) AS n, contains(lower(text), 'mailto:') OR len(found) > 0 AS leak FROM a WHERE text IS NOT NULL
""")
def f15_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses per document and whether any is left open."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.addresses(t)).alias("n"), text.has_leak(t).alias("leak"))


@query("""
SELECT DISTINCT source_path, split_part(source_path, '/', 1) AS top, regexp_extract(source_path, '([^/]*)$', 1) AS name, regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS dir,
  replace(source_path, '/', '__') AS id FROM episodes WHERE source_path IS NOT NULL
""")
def f20_path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of stored paths and the ids made of them."""
    p = F.col("source_path")
    return table(spark, d, "episodes").where("source_path is not null").select("source_path", urls.first_segment(p).alias("top"), urls.basename(p).alias("name"), urls.dirname(p).alias("dir"), urls.episode_key(p, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("id")).distinct()


@query("""
SELECT DISTINCT homepage, array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(lower(regexp_extract(homepage, '^[a-z]+://([^/]+)', 1)), ':\\d+$', ''), '^www\\d*\\.', ''), '.')), ',') AS surt
FROM authors WHERE homepage IS NOT NULL
""")
def f33_surt_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Reversed hosts of homepages."""
    return table(spark, d, "authors").where("homepage is not null").select("homepage", urls.surt_host(F.regexp_extract("homepage", "^[a-z]+://([^/]+)", 1)).alias("surt")).distinct()


_WIDE, _THIN = text.WIDE.replace("'", "''"), text.THIN.replace("'", "''")


@query(f"""
SELECT entry_no, CASE WHEN c <> '' THEN c ELSE title END AS core FROM (SELECT entry_no, title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(translate(title, '{_WIDE}', '{_THIN}'), ' '),
  '[\\s　]*[（(][0-9０-９]+[)）]$', ''), '[\\s　]*第[0-9０-９一二三四五六七八九十百]+[話回章部夜]$', ''), '[\\s　]*その[0-9０-９一二三四五六七八九十]+$', ''),
  '(?i)[\\s　]*(?:lesson|episode|stage|no\\.?|vol\\.?|act|part)[\\s　]*[0-9０-９]+$', ''), '[\\s　]+[0-9０-９一二三四五六七八九十]+$', '') AS c FROM episodes WHERE title IS NOT NULL)
""")
def f42_title_cores(spark: SparkSession, d: str) -> DataFrame:
    """Titles without their numbers."""
    return table(spark, d, "episodes").where("title is not null").select("entry_no", text.title_core(F.col("title")).alias("core"))


@query("SELECT doc_id, CASE WHEN n_chars >= 200 THEN greatest(1, floor(n_chars / 550.0 + 0.5)::INTEGER) END AS minutes, sha256('salt|' || source) AS who FROM documents")
def f57_hash_and_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Reading minutes of documents and hashed sources."""
    return table(spark, d, "documents").select("doc_id", text.reading_minutes(F.col("n_chars")).alias("minutes"), text.salted_hash(F.col("source"), "salt").alias("who"))


#: Words of subjects and the routes they mean, the first one counting.
_ROUTES = {"commoncrawl": "commoncrawl", "魚拓": "megalodon", "wayback": "wayback", "pixiv": "pixiv", "mirror": "mirror", "再掲": "repost"}
_HITS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(s), '{w}') THEN '{k}' END" for w, k in _ROUTES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""
WITH e AS (SELECT entry_no, coalesce(route, '') || CASE entry_no % 4 WHEN 0 THEN ' Wayback と CommonCrawl' WHEN 1 THEN ' ウェブ魚拓から' WHEN 2 THEN '' ELSE ' PIXIV 再掲' END AS s FROM episodes)
SELECT entry_no, coalesce(h[1], 'other') AS kind, len(h) > 1 AS mixed FROM (SELECT entry_no, {_HITS} AS h FROM e)
""")
def f34_route_classes(spark: SparkSession, d: str) -> DataFrame:
    """Routes by the first rule that a subject meets, and whether it meets several."""
    k = F.col("entry_no") % 4
    s = F.concat(F.coalesce("route", F.lit("")), F.when(k == 0, " Wayback と CommonCrawl").when(k == 1, " ウェブ魚拓から").when(k == 2, "").otherwise(" PIXIV 再掲"))
    r = text.first_rule(s, _ROUTES)
    return table(spark, d, "episodes").select("entry_no", r["kind"].alias("kind"), r["mixed"].alias("mixed"))


# ---- markup and conversion


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM documents)
SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1
""")
def tvf01_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the corpus."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("</?([A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag"))
    return t.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(line) > 30) AS long_lines, count(*) FILTER (length(line) > 30) > 30 AS hard_wrapped FROM l GROUP BY doc_id
""")
def txt06_hard_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Documents with hard-wrapped lines."""
    lines = F.split("text", "\n", -1)
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.length(x) > 30)).cast("long").alias("long_lines"), markup.hard_wrapped(F.col("text")).alias("hard_wrapped")
    )


@query(r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<![^>]*>', '', 'g'), '(?is)<form\b.*?</form\s*>', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(p, '<([^/A-Za-z])', '&lt;\1', 'g'), '<(/?)$', '&lt;\1') AS p FROM c),
l AS (SELECT doc_id, p, string_split(regexp_replace(regexp_replace(regexp_replace(p, '(?i)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-6]|hr|/?blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM b),
t AS (SELECT doc_id, p, list_filter(list_transform(lines, lambda x: regexp_replace(x, '^[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+|[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+$', '', 'g')), lambda x: x <> '') AS lines FROM l)
SELECT doc_id, 'equal' AS proof, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::INTEGER + 2 * greatest(len(lines) - 1, 0)::INTEGER AS n FROM t
""")
def txt09_lossless_proof(spark: SparkSession, d: str) -> DataFrame:
    """Whether the plain form of each text keeps all of it."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("a"), markup.converted(F.col("text")).alias("b"))
    return t.select("doc_id", markup.proof(F.col("a"), F.col("b")).alias("proof"), F.length("b").alias("n"))


@query("""
WITH k AS (SELECT doc_id, md5(text) AS h, md5(regexp_replace(text, '<[^>]+>|[ \\t\\r\\n　]+', '', 'g')) AS g FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS same_bytes, min(doc_id) OVER (PARTITION BY g) AS same_text FROM k
""")
def txt15_identity_ladder(spark: SparkSession, d: str) -> DataFrame:
    """First document of the same bytes and of the same text without markup and blanks."""
    g = F.md5(F.regexp_replace("text", "<[^>]+>|[ \\t\\r\\n　]+", ""))
    k = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"), g.alias("g"))
    h = k.groupBy("h").agg(F.min("doc_id").alias("same_bytes"))
    t = k.groupBy("g").agg(F.min("doc_id").alias("same_text"))
    return k.join(h, "h").join(t, "g").select("doc_id", "same_bytes", "same_text")


# ---- clusters


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT entry_no AS x, 'f:' || source_path AS k FROM episodes WHERE source_path IS NOT NULL
  UNION SELECT DISTINCT entry_no, 'i:' || episode_id FROM episodes WHERE episode_id IS NOT NULL),
f AS (SELECT k, min(x) AS h FROM n GROUP BY k),
e AS (SELECT DISTINCT n.x AS a, f.h AS b FROM n JOIN f USING (k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS root FROM u WHERE a IN (SELECT h FROM f) UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node AS entry_no, min(root) AS work FROM r GROUP BY node
""")
def grf01_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Lines connected by file or id, as one work each."""
    e = table(spark, d, "episodes")
    keys = e.where("source_path is not null").select("entry_no", F.concat(F.lit("f:"), "source_path").alias("k")).unionByName(e.where("episode_id is not null").select("entry_no", F.concat(F.lit("i:"), "episode_id").alias("k"))).distinct()
    edges = graph.stars(keys, ["k"], "entry_no")
    alone = keys.select(F.col("entry_no").alias("x"), F.col("entry_no").alias("y")).distinct()
    return graph.components(edges.unionByName(alone)).select(F.col("node").alias("entry_no"), F.col("label").alias("work"))


@query()
def grf01_works(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its work, closed to one author, and the rules that joined it: equal file or id, then within an
    author the same directory and file stem, or the same title core of four or more characters.

    A cluster of equal files and ids has the author of most of its lines; without one it joins no other.
    """
    e = table(spark, d, "episodes")
    name = F.concat(F.lit("n:"), F.when(text.norm_name("author") != "", text.norm_name("author")))
    who = join15_author_cascade(spark, d).select("entry_no", F.concat(F.lit("s:"), "slug").alias("_s"))
    stem = F.regexp_replace(F.regexp_replace(urls.basename(F.col("source_path")), r"\.[^.]*$", ""), r"[\s\-_]*[0-9０-９]+$", "")
    lines = (
        e.join(grf01_clusters(spark, d), "entry_no", "left").join(who, "entry_no", "left")
        .select("entry_no", "source_path", "episode_id", F.coalesce("work", "entry_no").alias("base"), F.coalesce("_s", name).alias("author"),
                F.struct(urls.dirname(F.col("source_path")).alias("dir"), F.when(stem != "", stem).alias("stem")).alias("place"), text.title_core(F.col("title")).alias("core"))
    )
    lines = checkpointed(lines)
    votes = lines.where("author is not null").groupBy("base", "author").agg(F.count("*").alias("n"))
    authors = votes.groupBy("base").agg(F.min(F.struct(-F.col("n"), "author"))["author"].alias("author"))
    places = lines.where("place.stem is not null").select("base", F.lit("filename-stem").alias("rule"), F.to_json("place").alias("k"))
    cores = lines.where("length(core) >= 4").select("base", F.lit("title-prefix").alias("rule"), F.col("core").alias("k"))
    members = checkpointed(places.unionByName(cores).distinct().join(authors, "base"))
    alone = lines.select(F.col("base").alias("x"), F.col("base").alias("y")).distinct()
    works = graph.components(graph.stars(members, ["rule", "author", "k"], "base").unionByName(alone)).select(F.col("node").alias("base"), F.col("label").alias("work"))
    same = [lines.where(f"{c} is not null").groupBy(c).agg(F.min("base").alias("base"), F.count("*").alias("n")).select("base", "n", F.lit(rule).alias("rule")) for c, rule in (("source_path", "path"), ("episode_id", "id"))]
    joined = members.groupBy("rule", "author", "k").agg(F.min("base").alias("base"), F.count("*").alias("n")).select("base", "n", "rule").unionByName(same[0]).unionByName(same[1])
    evidence = joined.where("n > 1").join(works, "base").groupBy("work").agg(F.array_sort(F.collect_set("rule")).alias("evidence"))
    out = lines.select("entry_no", "base").join(works, "base").join(authors, "base", "left").join(evidence, "work", "left")
    return out.select("entry_no", "work", "author", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


@query("""
WITH m AS (SELECT DISTINCT work_slug, evidence, episode_count, x.episode_id AS e FROM (SELECT work_slug, evidence, episode_count, unnest(episodes) AS x FROM works)),
g AS (SELECT work_slug, any_value(evidence) AS ev, max(episode_count) AS n, count(DISTINCT regexp_extract(e, '^(.*)__[^_]*', 1)) AS dirs FROM m GROUP BY work_slug)
SELECT work_slug, n >= 15 AS large, dirs > 1 AS many_dirs, len(list_filter(ev, lambda x: x NOT IN ('filename-stem', 'title-prefix', 'title', 'directory'))) = 0 AS weak FROM g WHERE ev IS NOT NULL
""")
def grf02_review_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Works to review: large, of several directories, weakly founded."""
    w = table(spark, d, "works").select("work_slug", "evidence", "episode_count", F.explode("episodes.episode_id").alias("e"))
    g = w.groupBy("work_slug").agg(F.first("evidence", ignorenulls=True).alias("ev"), F.max("episode_count").alias("n"), F.count_distinct(F.regexp_extract("e", r"^(.*)__[^_]*", 1)).alias("dirs")).where("ev is not null")
    weak = F.array(*[F.lit(x) for x in ("filename-stem", "title-prefix", "title", "directory")])
    return g.select("work_slug", (F.col("n") >= 15).alias("large"), (F.col("dirs") > 1).alias("many_dirs"), (F.size(F.array_except("ev", weak)) == 0).alias("weak"))


# ---- merges and checks

_COLS = ["corpus", "title", "author", "kansou_slug", "size_kb"]
_HASH = "md5(concat_ws('|', " + ", ".join(f"coalesce('=' || {c}::VARCHAR, '~')" for c in _COLS) + "))"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY entry_no) AS a, row_number() OVER (PARTITION BY episode_id ORDER BY entry_no DESC) AS z FROM episodes WHERE episode_id IS NOT NULL),
o AS (SELECT episode_id, {_HASH} AS h FROM r WHERE a = 1 AND corpus IS DISTINCT FROM 'dojo'), n AS (SELECT episode_id, {_HASH} AS h FROM r WHERE z = 1 AND corpus IS DISTINCT FROM 'legacy')
SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.h IS NULL THEN 'create' WHEN n.h IS NULL THEN 'keep' WHEN o.h = n.h THEN 'skip' ELSE 'update' END AS action
  FROM n FULL JOIN o USING (episode_id)) GROUP BY action
""")
def mrg01_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """What loading the newest lines over the oldest would do."""
    e = table(spark, d, "episodes").where("episode_id is not null")
    old = records.best_per_key(e, ["episode_id"], [F.col("entry_no")]).where("not corpus <=> 'dojo'")
    new = records.best_per_key(e, ["episode_id"], [F.desc("entry_no")]).where("not corpus <=> 'legacy'")
    return records.merge_plan(new, old, "episode_id", _COLS).groupBy("action").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT DISTINCT slug AS k, display_name AS v FROM authors WHERE slug_status = 'confirmed'),
n AS (SELECT author_slug AS k, min(credit) AS v FROM works WHERE author_slug IS NOT NULL GROUP BY 1)
SELECT coalesce(o.k, n.k) AS slug, CASE WHEN o.k IS NULL THEN n.v ELSE o.v END AS value, CASE WHEN o.k IS NULL THEN 'candidate' WHEN n.k IS NULL THEN 'stale' ELSE 'confirmed' END AS status FROM o FULL JOIN n USING (k)
""")
def mrg05_section_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names of slugs: confirmed ones stay, stale where no work uses them, others are candidates."""
    old = table(spark, d, "authors").select("slug", F.col("display_name").alias("value"), F.col("slug_status").alias("status")).distinct()
    new = table(spark, d, "works").where("author_slug is not null").groupBy(F.col("author_slug").alias("slug")).agg(F.min("credit").alias("value"))
    return records.section_merge(old, new, "slug")



@query("""
WITH c AS (SELECT episode_id, count(*) AS n FROM episodes GROUP BY 1)
SELECT entry_no, CASE WHEN c.n = 1 AND ends_with(e.episode_id, '01.html') THEN 'first' ELSE e.route END AS route,
  c.n = 1 AND ends_with(e.episode_id, '01.html') AND e.route IS DISTINCT FROM 'first' AS changed FROM episodes e JOIN c USING (episode_id)
""")
def mrg06_overrides(spark: SparkSession, d: str) -> DataFrame:
    """A field set by rule where exactly one line has the key, with its trail."""
    e = table(spark, d, "episodes").where("episode_id is not null").select("entry_no", "episode_id", "route")
    rules = e.where("episode_id like '%01.html'").select(F.col("episode_id").alias("key"), F.lit("route").alias("field"), F.lit("first").alias("value"), F.lit(None).cast("string").alias("expect")).distinct()
    out, _ = records.overridden(e, rules, "episode_id", ["route"])
    return out.select("entry_no", "route", (F.size("overrides_applied") > 0).alias("changed"))


@query("""
SELECT 'ids_unique' AS name, count(*) = count(DISTINCT entry_no) AS ok FROM episodes
UNION ALL SELECT 'corpus_filled', count(*) FILTER (corpus IS NULL OR corpus = '') = 0 FROM episodes
UNION ALL SELECT 'members_exist', count(*) = 0 FROM (SELECT unnest(episodes) AS x FROM works) WHERE x.episode_id NOT IN (SELECT episode_id FROM episodes WHERE episode_id IS NOT NULL)
UNION ALL SELECT 'labels_in_range', count(*) FILTER (quality NOT BETWEEN 1 AND 5 OR toxic NOT IN (0, 1)) = 0 FROM labels
UNION ALL SELECT 'lengths_hold', count(*) FILTER (n_chars <> length(text)) = 0 FROM documents
""")
def dq01_checks(spark: SparkSession, d: str) -> DataFrame:
    """A bundle of checks."""
    e, w = table(spark, d, "episodes"), table(spark, d, "works")
    members = w.select(F.explode("episodes.episode_id").alias("episode_id")).where("episode_id is not null").join(e.select("episode_id").distinct(), "episode_id", "left_anti")
    bundle = [
        ("ids_unique", e.agg(F.count("*").alias("n"), F.count_distinct("entry_no").alias("k")), F.col("n") == F.col("k")),
        ("corpus_filled", e.agg(F.count_if(F.coalesce(F.col("corpus") == "", F.lit(True))).alias("bad")), F.col("bad") == 0),
        ("members_exist", members.agg(F.count("*").alias("bad")), F.col("bad") == 0),
        ("labels_in_range", table(spark, d, "labels").agg(F.count_if(~F.col("quality").between(1, 5) | ~F.col("toxic").isin(0, 1)).alias("bad")), F.col("bad") == 0),
        ("lengths_hold", table(spark, d, "documents").agg(F.count_if(F.col("n_chars") != F.length("text")).alias("bad")), F.col("bad") == 0),
    ]
    return records.checks(bundle).select("name", "ok")


@query("""
WITH w AS (SELECT DISTINCT work_slug, episodes FROM works), a AS (SELECT work_slug, unnest(range(1, len(episodes) + 1)) AS n, unnest(list_transform(episodes, lambda x: x.episode_id)) AS e FROM w),
b AS (SELECT work_slug, row_number() OVER (PARTITION BY work_slug, episodes ORDER BY i) AS n, e FROM (SELECT work_slug, episodes, unnest(range(len(episodes))) AS i, unnest(list_transform(episodes, lambda x: x.episode_id)) AS e FROM w))
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS differing, (SELECT count(*) FROM a) AS lines
""")
def dq10_rerun_parity(spark: SparkSession, d: str) -> DataFrame:
    """Members of works made by two plans, by place in the list and by numbering the opened list, and how many rows differ."""
    w = table(spark, d, "works").select("work_slug", "episodes").distinct()
    a = join18_membership(spark, d).select("work_slug", F.col("ordinal").cast("long").alias("n"), F.col("episode_id").alias("e"))
    # the other plan zips the list with a sequence of its places
    places = F.arrays_zip(F.sequence(F.lit(1), F.size("episodes")).alias("n"), F.col("episodes.episode_id").alias("e"))
    b = w.where("size(episodes) > 0").select("work_slug", F.explode(places).alias("x")).select("work_slug", F.col("x")["n"].cast("long").alias("n"), F.col("x")["e"].alias("e"))
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1))).groupBy("work_slug", "n", "e").agg(F.sum("_s").alias("_s"), F.count_if(F.col("_s") > 0).alias("_a"))
    return both.agg(F.coalesce(F.sum(F.abs("_s")), F.lit(0)).alias("differing"), F.coalesce(F.sum("_a"), F.lit(0)).alias("lines"))


# ---- serving


@query("""
SELECT e.entry_no FROM episodes e WHERE contains(lower(e.title), '灯') AND EXISTS (SELECT 1 FROM works w WHERE list_contains(list_transform(w.episodes, lambda x: x.episode_id), e.episode_id) AND list_contains(w.evidence, 'directory'))
ORDER BY e.entry_no LIMIT 10
""")
def qry01_search_with_facet(spark: SparkSession, d: str) -> DataFrame:
    """First page of a keyword search under a facet."""
    facet = table(spark, d, "works").where(F.array_contains("evidence", "directory")).select(F.explode("episodes.episode_id").alias("episode_id"))
    hits = table(spark, d, "episodes").where(F.lower("title").contains("灯")).select("entry_no", "episode_id")
    return hits.join(facet, "episode_id", "left_semi").select("entry_no").orderBy("entry_no").limit(10)


@query("""
SELECT coalesce(a.yomi_group, '他') AS yomi_group, a.slug, count(DISTINCT w.work_slug) AS works FROM (SELECT DISTINCT slug, yomi_group FROM authors) a JOIN works w ON w.author_slug = a.slug GROUP BY 1, 2
""")
def qry03_author_index(spark: SparkSession, d: str) -> DataFrame:
    """Author index by kana group with works; authors without works are left out."""
    a = table(spark, d, "authors").select("slug", F.coalesce("yomi_group", F.lit("他")).alias("yomi_group")).distinct()
    w = table(spark, d, "works").select(F.col("author_slug").alias("slug"), "work_slug")
    return w.join(a, "slug").groupBy("yomi_group", "slug").agg(F.count_distinct("work_slug").alias("works"))


@query(f"""
WITH al AS ({_ALIAS}), g AS (SELECT DISTINCT entry_no, g FROM (SELECT entry_no, unnest(genre_raw) AS g FROM episodes))
SELECT al.slug, count(DISTINCT entry_no) AS n FROM g JOIN al ON al.a = g.g AND al.taxonomy = 'ts_genre' GROUP BY 1 ORDER BY n DESC, slug LIMIT 14
""")
def qry05_genre_chips(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen most used genres."""
    g = table(spark, d, "episodes").select("entry_no", F.explode("genre_raw").alias("a")).distinct()
    return g.join(_aliases(spark, d).where("taxonomy = 'ts_genre'"), "a").groupBy("slug").agg(F.count_distinct("entry_no").alias("n")).orderBy(F.desc("n"), "slug").limit(14)


@query("""
SELECT entry_no, role, CASE WHEN withdrawn_at IS NOT NULL THEN 'gone' WHEN entry_role = 'notice' AND role = 'committee' THEN 'show_hidden' WHEN entry_role = 'notice' THEN 'not_found' ELSE 'pass' END AS answer
FROM (SELECT *, unnest(['reader', 'committee']) AS role FROM episodes)
""")
def qry11_visible(spark: SparkSession, d: str) -> DataFrame:
    """What readers and the committee get for each line."""
    e = table(spark, d, "episodes").withColumn("role", F.explode(F.array(F.lit("reader"), F.lit("committee"))))
    status = F.when(F.col("withdrawn_at").isNotNull(), "withdrawn").otherwise("publish")
    hidden = F.coalesce(F.col("entry_role") == "notice", F.lit(False))
    return e.select("entry_no", "role", records.visible(status, hidden, F.col("role") == "committee").alias("answer"))


@query("""
SELECT DISTINCT 'e:' || a AS src, 'w:' || work_slug AS dst FROM (SELECT work_slug, unnest([x.episode_id, replace(x.episode_id, '__', '/'), lower(x.episode_id)]) AS a FROM (SELECT work_slug, unnest(episodes) AS x FROM works)) WHERE a IS NOT NULL
""")
def qry10_pathmap(spark: SparkSession, d: str) -> DataFrame:
    """Map of ids and their aliases (as a path, in lower case) to the works that hold them."""
    m = table(spark, d, "works").select("work_slug", F.explode("episodes.episode_id").alias("e")).where("e is not null").distinct()
    forms = F.array("e", F.replace("e", F.lit("__"), F.lit("/")), F.lower("e"))
    return m.select(F.explode(F.array_distinct(forms)).alias("a"), "work_slug").select(F.concat(F.lit("e:"), "a").alias("src"), F.concat(F.lit("w:"), "work_slug").alias("dst")).distinct()


# ---- Spark built-in sanity, not derived from the catalogue


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def sanity_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scan, filter and aggregate over the largest table."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name
""")
def sanity_star_join(spark: SparkSession, d: str) -> DataFrame:
    """Three joins and an aggregate."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "n_name")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_r"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name").agg(F.round(F.sum("_r"), 2).alias("revenue"))
