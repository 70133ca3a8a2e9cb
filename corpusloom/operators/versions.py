"""Versions of one text: a ladder from equal bytes over equal text to similar text, canonical choice, title families."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAME, REVIEW = 0.95, 0.50


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching text between two strings, over the whole of both; null where one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def canonical(df: DataFrame, group: list[str], order: list, key: str) -> DataFrame:
    """`df` with `canonical`, the key of the group's first row in the given order, and `superseded`."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("canonical", F.first(key).over(w)).withColumn("superseded", F.row_number().over(w) > 1)


def compared_versions(df: DataFrame, group: list[str], order: list, key: str, text: str) -> DataFrame:
    """(key, canonical, step, sim, verdict) of every version against its group's canonical one; no pairs among the others.

    step: bytes, text (equal without markup and blanks) or similar; verdict: same, review or distinct.
    """
    c = canonical(df, group, order, key)
    heads = c.where("not superseded").select(F.col(key).alias("_c"), F.col(text).alias("_t"))
    j = c.where("superseded").join(heads, F.col("canonical") == F.col("_c"))
    plain = lambda x: F.regexp_replace(F.col(x), r"(?U)<[^>]+>|\s+", "")
    j = j.withColumn("step", F.when(F.col(text) == F.col("_t"), "bytes").when(plain(text) == plain("_t"), "text").otherwise("similar"))
    exact = j.where("step <> 'similar'").withColumn("sim", F.lit(1.0))
    # matching is quadratic in the length: a fixed number of partitions keeps it spread over the cores
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = j.where("step = 'similar'").repartition(parts, key).withColumn("sim", similarity(F.col(text), F.col("_t")))
    out = exact.unionByName(near)
    return out.select(key, "canonical", "step", F.round("sim", 4).alias("sim"), F.when(F.col("sim") >= SAME, "same").when(F.col("sim") >= REVIEW, "review").otherwise("distinct").alias("verdict"))


def families(df: DataFrame, work: str, order: str, core: str, least: int = 2) -> DataFrame:
    """(work, order, core, family): title cores of a work grouped greedily in order, each into the first family with a
    member that shares a beginning of `least` characters or is equal.

    Sharing a beginning of fixed length is an equivalence, so a family is its beginning, numbered by first appearance.
    A null core counts as empty.
    """
    c = F.coalesce(core, F.lit(""))
    d = df.select(work, order, core).withColumn("_start", F.when(F.length(c) >= least, F.substring(c, 1, least)).otherwise(F.concat(F.lit("="), c)))
    d = d.withColumn("_first", F.min(F.struct(order, core)).over(Window.partitionBy(work, "_start")))
    return d.withColumn("family", (F.dense_rank().over(Window.partitionBy(work).orderBy("_first", "_start")) - 1).cast("int")).select(work, order, core, "family")
