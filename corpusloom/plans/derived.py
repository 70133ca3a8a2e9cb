"""Queries of the link, parser, version and stream operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.charsets import decoded
from corpusloom.operators import links, parsers, versions
from corpusloom.operators.bounded import shared_folder
from corpusloom.plans.rules import _CORE
from corpusloom.sources.tables import table
from corpusloom.streaming import rates

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
WITH l AS (SELECT DISTINCT regexp_replace(source_path, '\\.html$', '') AS target FROM episodes WHERE source_path IS NOT NULL),
p AS (SELECT DISTINCT source_path AS path FROM episodes WHERE source_path IS NOT NULL),
f AS (SELECT path, path AS form FROM p UNION SELECT path, regexp_replace(path, '\\.html$', '') FROM p WHERE ends_with(path, '.html')
  UNION SELECT path, regexp_replace(path, '/?index\\.html?$', '') FROM p WHERE regexp_matches(path, '(^|/)index\\.html?$')
  UNION SELECT path, regexp_replace(path, 'index\\.html?$', '') FROM p WHERE regexp_matches(path, '(^|/)index\\.html?$')),
b AS (SELECT form, arg_min(path, (length(path), path)) AS found FROM f WHERE form <> '' GROUP BY form)
SELECT l.target, b.found FROM l LEFT JOIN b ON b.form = l.target
""")
def join02_resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Links without their suffix against the stored paths."""
    p = table(spark, d, "episodes").select("source_path").where("source_path is not null").distinct()
    t = p.select(F.regexp_replace("source_path", r"\.html$", "").alias("target")).distinct()
    return links.resolve(t, "target", p, "source_path")


@query("""
WITH m AS (SELECT DISTINCT replace(regexp_replace(x.episode_id, '[@+].*$', ''), '__', '/') AS target FROM (SELECT unnest(episodes) AS x FROM works) WHERE x.episode_id IS NOT NULL),
p AS (SELECT DISTINCT source_path AS s FROM episodes WHERE source_path IS NOT NULL),
t AS (SELECT target FROM m WHERE target NOT IN (SELECT s FROM p)),
c AS (SELECT target, regexp_replace(target, '\\.html$', '.htm') AS c FROM t UNION SELECT target, regexp_replace(target, '\\.htm$', '.html') FROM t UNION SELECT target, lower(target) FROM t
  UNION SELECT target, regexp_replace(target, '^[^/]+/', '') FROM t),
h AS (SELECT DISTINCT target, s FROM c JOIN p ON c.c = p.s WHERE c.c <> target)
SELECT t.target, CASE WHEN count(s) = 1 THEN min(s) END AS fixed, count(s) AS ways FROM t LEFT JOIN h USING (target) GROUP BY t.target
""")
def join08_repaired_links(spark: SparkSession, d: str) -> DataFrame:
    """Referenced paths that are missing, with the one stored path that their candidates meet."""
    m = table(spark, d, "works").select(F.explode("episodes.episode_id").alias("e")).where("e is not null")
    m = m.select(F.replace(F.regexp_replace("e", r"[@+].*$", ""), F.lit("__"), F.lit("/")).alias("target")).distinct()
    return links.repaired(m, "target", table(spark, d, "episodes").where("source_path is not null"), "source_path")


@query("""
SELECT doc_id, pos AS line_no, '誤字' AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS pos FROM documents)
WHERE contains(line, '誤字')
""")
def tvf13_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a listed word."""
    return parsers.banned_lines(table(spark, d, "documents"), "doc_id", "text", ["誤字"])


@query("SELECT doc_id, length(text) AS n, 'utf-8' AS encoding FROM documents WHERE text IS NOT NULL")
def src02_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the documents through the character-set guess."""
    b = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return b.select("doc_id", decoded(F.col("b")).alias("d")).select("doc_id", F.length("d.text").alias("n"), "d.encoding")


@query()
def txt14_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one kind and episode, long bodies too, against the first of them: bytes, text, similar."""
    t = table(spark, d, "documents").where("text is not null and episode_id is not null").select("doc_id", "kind", "episode_id", "text")
    return versions.compared_versions(t, ["kind", "episode_id"], [F.col("doc_id")], "doc_id", "text")


@query(f"""
WITH c AS (SELECT DISTINCT work_slug, ord AS ordinal, core, CASE WHEN length(coalesce(core, '')) >= 2 THEN left(core, 2) ELSE '=' || coalesce(core, '') END AS start FROM {_CORE}),
f AS (SELECT work_slug, start, min((ordinal, core)) AS first FROM c GROUP BY 1, 2), g AS (SELECT work_slug, start, (dense_rank() OVER (PARTITION BY work_slug ORDER BY first, start) - 1)::INTEGER AS family FROM f)
SELECT c.work_slug, c.ordinal, c.core, g.family FROM c JOIN g USING (work_slug, start)
""")
def grf04_families(spark: SparkSession, d: str) -> DataFrame:
    """Families of title cores inside each work."""
    w = table(spark, d, "works").select("work_slug", F.explode("episodes").alias("e")).select("work_slug", F.col("e.ordinal").alias("ordinal"), text.title_core(F.col("e.title")).alias("core"))
    return versions.families(w.distinct(), "work_slug", "ordinal", "core")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def str04_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per user and hour, counted by a stream that reads the whole table and ends."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    counts = rates.windowed_counts(stream, "user_id", "ts", late="365 days")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    run = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_WINDOWS = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events WHERE user_id IS NOT NULL),
w AS (SELECT user_id, min(s) AS a FROM e GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(e.s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.a + 3600) FROM w WHERE w.a IS NOT NULL),
o AS (SELECT user_id, a, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), 9000000000000) AS z FROM w WHERE a IS NOT NULL),
r AS (SELECT e.event_id, e.s, e.user_id, row_number() OVER (PARTITION BY e.user_id, o.a ORDER BY e.s, e.event_id) AS n FROM e JOIN o ON o.user_id = e.user_id AND e.s >= o.a AND e.s < o.z)
"""


@query(f"{_WINDOWS} SELECT event_id, n FROM r")
def win13_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each event's place in the hour that its user's first event outside the last such hour opened."""
    e = table(spark, d, "events").where("user_id is not null")
    return rates.fixed_windows(e, "user_id", "ts", "event_id").select(F.col("id").alias("event_id"), "n")


@query(f"{_WINDOWS} SELECT user_id, count(*) AS hits, count(*) FILTER (n > 3) AS refused FROM r GROUP BY user_id")
def str04_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hits and refusals of each user when more than three in a window are refused, by a stream that reads the table and ends."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp"))).where("user_id is not null")
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    run = rates.limited(stream, "user_id", "ts", late="365 days").writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("hits"), F.count_if(~F.col("allowed")).alias("refused"))
