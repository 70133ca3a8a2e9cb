"""References to records that do not exist, exist too late or no longer exist.

Distinct non-null foreign keys meet the distinct parent keys in a left anti-join; what is missing joins back to the
references. Keys that do exist carry three map-side aggregates of their rows' lives, which decide nearly every
reference; the rest meets the closed lives of its key by month.

Defined results: a null key is no reference; a null moment gives a null period and can only be missing; a parent row
without a start never begins; repeated references and parent rows count once; empty tables give empty results or, for
the parents, only missing references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs(field, owner, key, at) against parents(field, key, begins, ends): one distinct row of refs for each reference
    without a parent row that lives at `at`, with `reason` missing, late (every row begins after `at`) or deleted.
    """
    every = refs.where(F.col("key").isNotNull())
    refs = every.distinct()
    lives = parents.where(F.col("key").isNotNull()).select("field", "key", "begins", "ends")
    known = lives.groupBy("field", "key").agg(
        F.min("begins").alias("_first"),
        F.min(F.when(F.col("ends").isNull(), F.col("begins"))).alias("_open"),
    )
    keys = refs.select("field", "key").distinct()
    absent = keys.join(known.select("field", "key"), ["field", "key"], "left_anti")
    status = absent.select("field", "key", F.lit(True).alias("_absent"), F.lit(None).cast("timestamp_ntz").alias("_first"), F.lit(None).cast("timestamp_ntz").alias("_open")).unionByName(
        known.join(keys, ["field", "key"], "left_semi").select("field", "key", F.lit(False).alias("_absent"), F.col("_first").cast("timestamp_ntz"), F.col("_open").cast("timestamp_ntz"))
    )
    at = F.col("at").cast("timestamp_ntz")
    month = lambda c: F.trunc(c.cast("date"), "month")
    judged = (
        refs.join(status, ["field", "key"])
        .select(
            "field", "owner", "key", "at",
            F.when(F.col("_absent"), "missing")
            .when(at.isNull(), "lives")
            .when(F.col("_first").isNull() | (F.col("_first") > at), "late")
            .when(F.col("_open") <= at, "lives")
            .alias("reason"),
        )
        .where("not reason <=> 'lives'")
        .withColumn("_month", F.when(F.col("reason").isNull(), month(F.col("at"))))
    )
    # a life is opened into months no further than references reach, so an end in the far future costs nothing
    low, high = (every.agg(f("at").cast("timestamp_ntz")).scalar() for f in (F.min, F.max))
    lived = (
        lives.where("begins is not null and ends > begins")
        .select("field", "key", F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends"))
        .distinct()
        .where((F.col("begins") <= high) & (F.col("ends") > low))
        .select("field", "key", "begins", "ends", F.explode(F.sequence(month(F.greatest("begins", low)), month(F.least("ends", high)), F.expr("interval 1 month"))).alias("_month"))
    )
    # only the undecided ones carry a month; whatever meets no life there stays
    alive = (judged["at"].cast("timestamp_ntz") >= lived["begins"]) & (judged["at"].cast("timestamp_ntz") < lived["ends"])
    same = (judged["field"] == lived["field"]) & (judged["key"] == lived["key"]) & (judged["_month"] == lived["_month"])
    return judged.join(lived, same & alive, "left_anti").select("field", "owner", "key", "at", F.coalesce("reason", F.lit("deleted")).alias("reason"))


def orphan_counts(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Per field and month of the reference: all references, orphans by reason and their share. Empty months are left out."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    total = refs.where(F.col("key").isNotNull()).distinct().groupBy("field", period).agg(F.count("*").alias("refs"))
    bad = orphans(refs, parents).groupBy("field", period).agg(*[F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}") for r in ("missing", "late", "deleted")])
    same = F.expr("t.field = b.field and t.period <=> b.period")
    counts = [F.coalesce(f"b.n_{r}", F.lit(0)).alias(f"n_{r}") for r in ("missing", "late", "deleted")]
    return (
        total.alias("t").join(bad.alias("b"), same, "left").select("t.field", "t.period", "t.refs", *counts)
        .withColumn("orphan_pct", F.round(100.0 * (F.col("n_missing") + F.col("n_late") + F.col("n_deleted")) / F.col("refs"), 2))
    )
