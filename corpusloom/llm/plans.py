"""Queries of the text operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary slug meant by each typed value of terms and episodes."""
    from corpusloom.llm import canonical

    return canonical.found(*(_table(spark, sf_dir, t) for t in ("terms", "episodes", "vocabulary")))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values without an entry, with the number of rows that hold them."""
    none = p1_found(spark, sf_dir).where("slug = 'none'")
    return none.groupBy("field", "raw").agg(F.count("*").alias("n_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of author slugs that stand for the same person."""
    from corpusloom.llm import names

    return names.pairs(_table(spark, sf_dir, "authors"), _table(spark, sf_dir, "works").select("author_slug", "credit"))


def p3_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slug that stands for somebody, with the first slug of its person and how many the person has."""
    from corpusloom.llm import names

    who = names.persons(_table(spark, sf_dir, "authors"), _table(spark, sf_dir, "works").select("author_slug", "credit"))
    each = who.groupBy("person").agg(F.min("slug").alias("first_slug"), F.count("*").alias("slugs"))
    return who.join(each, "person").select("slug", "first_slug", "slugs")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of episodes whose path and anchor look the same though stored differently."""
    from corpusloom.llm import lookalikes

    episodes = _table(spark, sf_dir, "episodes").select("entry_no", "source_path", "source_anchor")
    pairs = lookalikes.same_looking_pairs(episodes, "entry_no", ["source_path", "source_anchor"])
    return pairs.select(F.col("a").alias("entry_a"), F.col("b").alias("entry_b"))


def p5_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode with the first episode of its place, how many share the place and in how many stored forms."""
    from corpusloom.llm import lookalikes
    from corpusloom.operators.bounded import checkpointed

    episodes = _table(spark, sf_dir, "episodes").select("entry_no", "source_path", "source_anchor")
    rows = checkpointed(lookalikes.places(episodes, "entry_no", ["source_path", "source_anchor"]))
    # forms are counted first, so a place with many rows is one small group of forms
    forms = rows.groupBy("place", "form").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    each = forms.groupBy("place").agg(F.min("first").alias("first_entry"), F.sum("n").alias("entries"), F.count("*").alias("forms"))
    return rows.join(each, "place").select(F.col("key").alias("entry_no"), "first_entry", "entries", "forms")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    from corpusloom.llm import bpe

    return bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", bpe.default_ranks())


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in containers of each binder's capacity in tokens."""
    from functools import reduce

    from corpusloom.llm import bpe, packing
    from corpusloom.operators.bounded import checkpointed

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = checkpointed(bpe.counted(docs, "doc_id", "text", bpe.default_ranks()))
    binders = _table(spark, sf_dir, "binders").select("binder", "capacity_tokens").distinct().orderBy("binder").collect()  # three rows, fixed
    parts = [packing.packed(sizes, "doc_id", "n_tokens", c).select(F.lit(b).alias("binder"), F.lit(c).alias("capacity_tokens"), "*") for b, c in binders]
    return reduce(DataFrame.unionByName, parts)


def p7_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per binder: containers, pieces, tokens and the share of space left in percent."""
    d = p7_containers(spark, sf_dir)
    return (
        d.groupBy("binder", "capacity_tokens")
        .agg(F.count_distinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("n").alias("tokens"))
        .withColumn("space_left_pct", F.round(100.0 * (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))), 3))
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose own text is abusive, hateful or sexual."""
    from corpusloom.llm import abuse

    return abuse.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").where("toxic").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    from corpusloom.llm import abuse

    return abuse.scored(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text").drop("text")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of cases in every source."""
    from corpusloom.llm import abuse

    return abuse.rates(_table(spark, sf_dir, "documents"), "source", "text")


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p3_found": p3_found, "p3_people": p3_people, "p5_found": p5_found, "p5_places": p5_places, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_space": p7_space, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
