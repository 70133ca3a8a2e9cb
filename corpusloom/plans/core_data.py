"""Queries of the core's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import references, timestamps
from corpusloom.operators.bounded import spread
from corpusloom.sources.tables import table

#: Years that a listing date of these tables can have.
LISTED = (1997, 2015)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing moment of every episode that has one."""
    episodes = spread(table(spark, sf_dir, "episodes").select("entry_no", "date_raw", "date", "recorder"))
    found = timestamps.normalised(episodes, ["date_raw", "date"], "recorder", table(spark, sf_dir, "clocks"), LISTED)
    return found.where("moment is not null").select("entry_no", "moment")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the moments were found: episodes per recorder, source column and kind."""
    episodes = spread(table(spark, sf_dir, "episodes").select("date_raw", "date", "recorder"))
    found = timestamps.normalised(episodes, ["date_raw", "date"], "recorder", table(spark, sf_dir, "clocks"), LISTED)
    return found.groupBy("recorder", "moment_from", "moment_kind").agg(F.count("*").alias("episodes"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    works = table(spark, sf_dir, "works")
    listed = works.select(F.lit("episodes").alias("field"), F.col("work_slug").alias("owner"), F.explode("episodes.episode_id").alias("key"), F.col("built_at").alias("at"))
    by = works.select(F.lit("author_slug").alias("field"), F.col("work_slug").alias("owner"), F.col("author_slug").alias("key"), F.col("built_at").alias("at"))
    episodes = table(spark, sf_dir, "episodes").select(F.lit("episodes").alias("field"), F.col("episode_id").alias("key"), F.col("loaded_at").alias("begins"), F.col("withdrawn_at").alias("ends"))
    authors = table(spark, sf_dir, "authors").select(F.lit("author_slug").alias("field"), F.col("slug").alias("key"), F.col("registered_at").alias("begins"), F.col("withdrawn_at").alias("ends"))
    return listed.unionByName(by), episodes.unionByName(authors)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of works to episodes and authors without a living target when the work was built."""
    bad = references.orphans(*_references(spark, sf_dir))
    return bad.select(
        F.col("field").alias("ref_field"), F.col("owner").alias("work_slug"), F.col("key").alias("ref_key"), F.date_format("at", "yyyy-MM").alias("period"), "reason"
    ).distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per field and month."""
    return references.orphan_counts(*_references(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_kinds": p2_kinds, "p4_found": p4_found, "p4_counts": p4_counts}

_REFS = """
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'episodes' AS field, work_slug AS owner, e.episode_id AS key, built_at AS at_
    FROM (SELECT work_slug, built_at, unnest(episodes) AS e FROM works)
    UNION ALL SELECT 'author_slug', work_slug, author_slug, built_at FROM works)
  WHERE key IS NOT NULL),
parents AS (
  SELECT 'episodes' AS field, episode_id AS key, loaded_at AS b, withdrawn_at AS e FROM episodes
  UNION ALL SELECT 'author_slug', slug, registered_at, withdrawn_at FROM authors),
joined AS (
  SELECT r.field, r.owner, r.key, r.at_, count(p.key) AS n, bool_or(p.b <= r.at_ AND (p.e IS NULL OR r.at_ < p.e)) AS lives, min(p.b) AS first_b
  FROM refs r LEFT JOIN parents p ON r.field = p.field AND r.key = p.key GROUP BY ALL),
bad AS (
  SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN first_b IS NULL OR first_b > at_ THEN 'late' ELSE 'deleted' END AS reason
  FROM joined WHERE n = 0 OR NOT coalesce(lives, false))
"""

SQL = {
    "p4_found": f"WITH {_REFS} SELECT DISTINCT field AS ref_field, owner AS work_slug, key AS ref_key, strftime(at_, '%Y-%m') AS period, reason FROM bad",
    "p4_counts": f"""WITH {_REFS},
t AS (SELECT field, strftime(at_, '%Y-%m') AS period, count(*) AS refs FROM refs GROUP BY ALL),
b AS (SELECT field, strftime(at_, '%Y-%m') AS period, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'late') AS n_late,
  count(*) FILTER (reason = 'deleted') AS n_deleted FROM bad GROUP BY ALL)
SELECT t.field, t.period, t.refs, coalesce(n_missing, 0) AS n_missing, coalesce(n_late, 0) AS n_late, coalesce(n_deleted, 0) AS n_deleted,
  round(100.0 * (coalesce(n_missing, 0) + coalesce(n_late, 0) + coalesce(n_deleted, 0)) / t.refs, 2) AS orphan_pct
FROM t LEFT JOIN b ON t.field = b.field AND t.period IS NOT DISTINCT FROM b.period""",
}
