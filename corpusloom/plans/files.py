"""Queries of readers and writers: each writes whole tables in a format to the folder all executors share and reads them back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.charsets import lenient
from corpusloom.operators.bounded import shared_folder
from corpusloom.plans.pages import _E, _cat, _episodes
from corpusloom.plans.registry import registry
from corpusloom.sources import files
from corpusloom.sources.tables import table

QUERIES, SQL, query = registry()


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """The folder of a text file of the lines in the column `value`."""
    at = _place(spark)
    lines.select("value").write.text(at)
    return at


@query("SELECT slug, display_name, array_to_string(display_variants, '|') AS variants, work_count FROM authors")
def src07_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Authors as JSON lines, nulls written out, and read under a schema."""
    at = _place(spark)
    a = table(spark, d, "authors").select("slug", "display_name", "display_variants", "work_count")
    files.write_jsonl(a, at, ["slug", "display_name"])
    return files.jsonl(spark, at, a.schema).select("slug", "display_name", F.array_join("display_variants", "|").alias("variants"), "work_count")


@query("SELECT taxonomy, list_sort(list(slug || ':' || name))[1] AS first_entry, count(*) AS n FROM vocabulary GROUP BY taxonomy")
def src08_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document of several lines for each taxonomy, read whole."""
    at = _place(spark)
    v = table(spark, d, "vocabulary").groupBy("taxonomy").agg(F.array_sort(F.collect_list(F.concat("slug", F.lit(":"), "name"))).alias("entries"))  # a fixed list
    files.write_report(v, at)
    return files.document(spark, at, "taxonomy string, entries array<string>").select("taxonomy", F.col("entries")[0].alias("first_entry"), F.size("entries").cast("long").alias("n"))


@query("SELECT slug, name FROM vocabulary WHERE taxonomy = 'ts_corpus'")
def src09_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule file written with a header and sorted keys and read again, as a table."""
    from pathlib import Path

    held = {r["slug"]: {"name": r["name"]} for r in table(spark, d, "vocabulary").where("taxonomy = 'ts_corpus'").collect()}  # one taxonomy of a fixed list
    at = Path(_place(spark).removeprefix("file:")) / "rules.json"
    at.parent.mkdir(parents=True)
    files.write_rules(held, str(at))
    return files.rule_table(spark, files.rules(str(at), required=True)).where("field = 'name'").select(F.col("key").alias("slug"), F.col("value").alias("name"))


@query("""
WITH c AS (SELECT 'k' || user_id AS urlkey, strftime(ts, '%Y%m%d%H%M%S') AS stamp, 'http://h/' || event_id AS original, (value * 100)::INTEGER AS length, CASE WHEN (value * 100)::INTEGER > 0 AND (value * 100)::INTEGER <= 700 THEN 0 ELSE 1 END AS q FROM events WHERE event_type <> 'error')
SELECT urlkey, original, stamp AS ts FROM (SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY q DESC, stamp DESC, original) AS rn FROM c) WHERE rn = 1
""")
def src14_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The best capture of each key out of a capture log: successes, whole pages before stubs, the newest first."""
    from corpusloom.operators import records

    e = table(spark, d, "events")
    line = F.concat_ws(" ", F.concat(F.lit("k"), "user_id"), F.concat(F.lit("http://h/"), "event_id"), F.date_format("ts", "yyyyMMddHHmmss"), F.when(F.col("event_type") == "error", "404").otherwise("200"), F.lit("text/html"), F.round(F.col("value") * 100).cast("int").cast("string"))
    log = files.capture_log(spark, _written(spark, e.select(line.alias("value")))).where("status = '200'")
    q = F.when((F.col("length") > 0) & (F.col("length") <= 700), 0).otherwise(1)
    return records.best_per_key(log.withColumn("_q", q), ["urlkey"], [F.desc("_q"), F.desc("ts"), F.col("original")]).select("urlkey", "original", "ts")


_CDX = "SELECT event_id, user_id, (value * 100)::INTEGER AS length, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events"


@query(f"SELECT 'k' || event_id AS urlkey, stamp AS ts, 'http://h/' || user_id AS original, CASE WHEN event_id % 10 = 0 THEN 0 ELSE length END AS length FROM ({_CDX}) WHERE event_id % 7 <> 0")
def src10_capture_log(spark: SparkSession, d: str) -> DataFrame:
    """Capture lines, short ones left out, bad lengths nought."""
    e = table(spark, d, "events")
    size = F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.round(F.col("value") * 100).cast("int").cast("string"))
    line = F.concat_ws("  ", F.concat(F.lit("k"), "event_id"), F.concat(F.lit("http://h/"), "user_id"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("200"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("text/html "), size)))
    at = _written(spark, e.select(line.alias("value")))
    return files.capture_log(spark, at).select("urlkey", "ts", "original", F.col("length").cast("int").alias("length"))


@query(f"SELECT 'http://h/' || entry_no AS url, 'p/' || a AS path FROM {_E} WHERE entry_no % 5 <> 0")
def src11_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and paths of a tab-separated list without comments and blank lines."""
    k = F.col("entry_no") % 5
    line = F.when(k == 0, F.when(F.col("entry_no") % 2 == 0, "# note\tx").otherwise("  ")).otherwise(_cat("http://h/", F.col("entry_no").cast("string"), "\t p/", F.col("a"), " "))
    return files.pairs(spark, _written(spark, _episodes(spark, d).select(line.alias("value"))))


@query(f"SELECT entry_no || ' ' || t || 'x' AS value FROM {_E} WHERE entry_no % 4 <> 0")
def src12_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a list without comments and blank ones."""
    line = F.when(F.col("entry_no") % 4 == 0, " #x").otherwise(_cat(F.col("entry_no").cast("string"), " ", F.col("t"), "x  "))
    return files.lines(spark, _written(spark, _episodes(spark, d).select(line.alias("value"))))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def src06_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Bytes read leniently; nothing readable is an empty text."""
    return table(spark, d, "documents").select("doc_id", lenient(F.encode("text", "UTF-8")).alias("text"))


@query("SELECT kind, count(*) AS pages, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL AND text <> '' AND kind IN ('body', 'notice') GROUP BY kind")
def src01_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a tree by directory; scripts and version control are passed by."""
    at = _place(spark)
    docs = table(spark, d, "documents").where("text is not null").select(F.col("kind"), F.encode("text", "UTF-8").alias("b"), F.concat("doc_id", F.when(F.col("kind").isin("body", "notice"), ".html").otherwise(".dat")).alias("name"))
    files.write_files(docs, at, F.concat_ws("/", "kind", "name"), F.col("b"))
    files.write_files(docs.where("name like '%1.html'"), at, F.concat(F.lit("scripts/"), "name"), F.col("b"))
    t = files.tree(spark, at)
    return t.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("kind")).agg(F.count("*").alias("pages"), F.sum("length").alias("bytes"))


@query("SELECT sha256(text) AS sha256, md5(text) AS md5, count(*) AS files FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY ALL")
def snk12_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files of a tree by content."""
    at = _place(spark)
    docs = table(spark, d, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("b"), F.concat("doc_id", F.lit(".md")).alias("name"))
    files.write_files(docs, at, F.col("name"), F.col("b"))
    return files.inventory(spark, at).groupBy("sha256", "md5").agg(F.count("*").alias("files"))


@query("SELECT DISTINCT 'e:' || x.episode_id AS src, 'w:' || work_slug AS dst FROM (SELECT work_slug, unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL")
def snk09_path_table(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs, sorted, tab-separated."""
    at = _place(spark)
    m = table(spark, d, "works").select("work_slug", F.explode("episodes.episode_id").alias("e")).where("e is not null")
    files.write_tsv(m.select(F.concat(F.lit("e:"), "e").alias("src"), F.concat(F.lit("w:"), "work_slug").alias("dst")), at)
    return files.tsv(spark, at, "src string, dst string")


@query("SELECT coalesce(entry_type, 'none') AS entry_type, count(*) AS n, min(entry_no) AS first_entry FROM (SELECT entry_type, entry_no + CASE WHEN entry_type = 'html' THEN 1 ELSE 0 END AS entry_no FROM episodes WHERE entry_type IS DISTINCT FROM 'html' OR entry_no % 2 = 0) GROUP BY 1")
def snk06_replaced_scope(spark: SparkSession, d: str) -> DataFrame:
    """One scope of a stored table replaced, the others left, whatever the number of runs."""
    at = _place(spark)
    e = table(spark, d, "episodes").select("entry_no", F.coalesce("entry_type", F.lit("none")).alias("entry_type"))
    files.replace_scope(e, at, "entry_type")
    for _ in range(2):
        files.replace_scope(e.where("entry_type = 'html' and entry_no % 2 = 0").withColumn("entry_no", F.col("entry_no") + 1), at, "entry_type")
    return spark.read.parquet(at).groupBy("entry_type").agg(F.count("*").alias("n"), F.min("entry_no").alias("first_entry"))


@query("SELECT entry_no FROM episodes WHERE episode_id IS NULL OR episode_id NOT IN (SELECT episode_id FROM episodes WHERE withdrawn_at IS NOT NULL AND episode_id IS NOT NULL)")
def snk05_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Output without the denied ids."""
    e = table(spark, d, "episodes")
    return files.tombstoned(e.select("entry_no", "episode_id"), e.where("withdrawn_at is not null"), "episode_id").select("entry_no")


@query("SELECT name, ok FROM (SELECT unnest(['rows', 'ids', 'written']) AS name, unnest([true, true, false]) AS ok)")
def snk07_check_mode(spark: SparkSession, d: str) -> DataFrame:
    """A run that checks and writes nothing."""
    from corpusloom.operators import records

    at = _place(spark)
    e = table(spark, d, "episodes").agg(F.count("*").alias("n"), F.count_distinct("entry_no").alias("k"))
    held = files.written(e, at, check=True)
    there = spark.createDataFrame([(files.exists(spark, at),)], "there boolean")
    return records.checks([("rows", held, F.col("n") > 0), ("ids", held, F.col("n") == F.col("k")), ("written", there, F.col("there"))]).select("name", "ok")


@query(f"""
WITH s AS (SELECT entry_no, 'x/' || entry_no || CASE entry_no % 4 WHEN 0 THEN '' ELSE '.html' END AS path, CASE entry_no % 3 WHEN 0 THEN 'tiny' ELSE repeat(t || 'y', 30) END AS body FROM {_E}), h AS (SELECT 'x/' || entry_no || '.html' AS path FROM episodes WHERE entry_no % 5 = 0)
SELECT entry_no, path, CASE WHEN strlen(body) < 10 THEN 'too-small' WHEN path IN (SELECT path FROM h) OR path || '.html' IN (SELECT path FROM h) THEN 'exists' ELSE 'place' END AS decision FROM s
""")
def snk08_staged(spark: SparkSession, d: str) -> DataFrame:
    """What happens to staged files: placed, there already (also under .html), or too small."""
    no = F.col("entry_no").cast("string")
    s = _episodes(spark, d).select("entry_no", F.concat(F.lit("x/"), no, F.when(F.col("entry_no") % 4 == 0, "").otherwise(".html")).alias("path"), F.encode(F.when(F.col("entry_no") % 3 == 0, "tiny").otherwise(F.repeat(F.concat("t", F.lit("y")), F.lit(30))), "UTF-8").alias("content"))
    held = table(spark, d, "episodes").where("entry_no % 5 = 0").select(F.concat(F.lit("x/"), "entry_no", F.lit(".html")).alias("path"))
    return files.staged(s, held, ["error 404"]).select("entry_no", "path", "decision")


@query("SELECT '| ' || slug || ' | ' || replace(replace(coalesce(name, ''), '|', '\\|'), chr(10), ' ') || ' |' AS line FROM vocabulary UNION ALL SELECT unnest(['| slug | name |', '|---|---|'])")
def snk11_markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A small table as Markdown lines."""
    v = table(spark, d, "vocabulary").select("slug", "name")
    lines = files.markdown_table(v, order=["slug", "name"])
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'gif' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'html' WHEN 4 THEN 'html' ELSE 'txt' END AS ext, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id % 12 = 0 WHEN 1 THEN doc_id % 4 = 1 WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN contains(text, '<') AND position('<' IN text) <= 20 ELSE true END AS agrees, doc_id % 6 = 3 AND strlen(text) + 20 <= 1200 AS stub FROM s
WHERE doc_id % 6 <> 4 OR NOT contains(text, '<')
""")
def fil07_types_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether files are what their suffix says, and whether they are error pages."""
    k = F.col("doc_id") % 6
    path = F.element_at(F.array(*[F.lit(f"a.{x}") for x in ("gif", "jpg", "png", "html", "html", "txt")]), (k + 1).cast("int"))
    head = F.when(k == 0, F.when(F.col("doc_id") % 12 == 0, F.unhex(F.lit("474946383961"))).otherwise(F.unhex(F.lit("000000")))).when(k == 1, F.when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("00")))).when(k == 2, F.unhex(F.lit("89504E47"))).when(k == 3, F.encode(F.lit("<title>404 not found"), "UTF-8")).otherwise(F.unhex(F.lit("")))
    s = table(spark, d, "documents").where("text is not null and (doc_id % 6 <> 4 or not contains(text, '<'))").select("doc_id", path.alias("path"), F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return s.select("doc_id", files.type_agrees(F.col("path"), F.col("content")).alias("agrees"), files.error_stub(F.col("path"), F.col("content"), ["404 not found"]).alias("stub"))
