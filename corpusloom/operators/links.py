"""Links against an inventory of paths: resolution by alternative forms, repair by candidates, hosts by longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.urls import NO_PAGE, mangled


def resolved_path(base: Column, href: Column) -> Column:
    """Target path of a relative link seen from the directory `base`, . and .. worked out; null where it leaves the tree."""
    parts = F.split(F.concat_ws("/", F.when(base != "", base), F.regexp_replace(href, "#.*$", "")), "/", -1)
    clean = F.filter(parts, lambda p: (p != "") & (p != "."))
    init = F.struct(F.array().cast("array<string>").alias("a"), F.lit(False).alias("out"))
    folded = F.aggregate(
        clean,
        init,
        lambda acc, p: F.when((p == "..") & (F.size(acc["a"]) == 0), F.struct(acc["a"].alias("a"), F.lit(True).alias("out")))
        .when(p == "..", F.struct(F.slice(acc["a"], F.lit(1), F.size(acc["a"]) - 1).alias("a"), acc["out"].alias("out")))
        .otherwise(F.struct(F.concat(acc["a"], F.array(p)).alias("a"), acc["out"].alias("out"))),
    )
    return F.when(~folded["out"], F.array_join(folded["a"], "/"))


def classified(url: Column, base: Column, home: str) -> Column:
    """struct<kind, target> of a link on a page of the directory `base`: skip, external or internal with its path.

    Fragments and other schemes are skipped; addresses of the home host and root-relative ones are internal; a relative
    one that leaves the tree is external. A query becomes part of the file's name.
    """
    u = F.trim(url)
    bare = F.regexp_replace(u, "#.*$", "")
    own = F.regexp_extract(bare, rf"(?i)^https?://(?:www\d*\.)?{home.replace('.', '[.]')}(?::\d+)?/?(.*)$", 1)
    is_own = bare.rlike(rf"(?i)^https?://(?:www\d*\.)?{home.replace('.', '[.]')}(?::\d+)?(?:/|$)")
    named = lambda p: mangled(F.regexp_replace(p, r"\?.*$", ""), F.when(p.contains("?"), F.regexp_replace(p, r"^[^?]*\?", "")), "flat")
    kept = named(F.when(is_own, own).when(bare.startswith("/"), F.regexp_replace(bare, "^/+", "")).otherwise(bare))
    inside = F.when(is_own | bare.startswith("/"), resolved_path(F.lit(""), kept)).otherwise(resolved_path(base, kept))
    st = lambda k, t: F.struct(F.lit(k).alias("kind"), t.cast("string").alias("target"))
    return (
        F.when((bare == "") | bare.rlike(NO_PAGE) | bare.rlike(r"^[^/]+@[^/]+$"), st("skip", F.lit(None)))
        .when(bare.rlike("(?i)^(?:https?:)?//") & ~is_own, st("external", bare))
        .when(inside.isNull(), st("external", bare))
        .otherwise(st("internal", inside))
    )


def link_forms(inventory: DataFrame, path: str) -> DataFrame:
    """(form, path): every form under which a stored path answers: itself, its directory for index pages, itself without .html."""
    p = F.col(path)
    forms = F.array_compact(
        F.array(
            p,
            F.when(p.rlike(r"(?:^|/)index\.html?$"), F.regexp_replace(p, r"/?index\.html?$", "")),
            F.when(p.rlike(r"(?:^|/)index\.html?$"), F.regexp_replace(p, r"index\.html?$", "")),
            F.when(p.endswith(".html"), F.regexp_replace(p, r"\.html$", "")),
        )
    )
    return inventory.select(p.alias("path"), F.explode(F.array_distinct(forms)).alias("form")).where("form <> ''").distinct()


def resolve(links: DataFrame, target: str, inventory: DataFrame, path: str) -> DataFrame:
    """`links` with `found`, the stored path that answers the target, or null; of several the shortest, then the first."""
    forms = link_forms(inventory, path).groupBy("form").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("_b"))
    return links.join(forms, F.col(target) == F.col("form"), "left").withColumn("found", F.col("_b.path")).drop("form", "_b")


def repaired(links: DataFrame, target: str, inventory: DataFrame, path: str) -> DataFrame:
    """(target, fixed, ways): targets that are missing, with the one stored path among their candidates, or with how many there were.

    Candidates: the other page suffix, lower case, one of two equal neighbouring parts left out, the part after the first slash.
    """
    inv = inventory.select(F.col(path).alias("_p")).distinct()
    t = links.select(F.col(target).alias("target")).where("target is not null").distinct().join(inv, F.col("target") == F.col("_p"), "left_anti")
    c = F.array(
        F.regexp_replace("target", r"\.html$", ".htm"),
        F.regexp_replace("target", r"\.htm$", ".html"),
        F.lower("target"),
        F.regexp_replace("target", r"(^|/)([^/]+)/\2(/|$)", "$1$2$3"),
        F.regexp_replace("target", r"^[^/]+/", ""),
    )
    hits = t.select("target", F.explode(F.array_distinct(c)).alias("_c")).where("_c <> target").join(inv, F.col("_c") == F.col("_p")).select("target", "_p").distinct()
    g = hits.groupBy("target").agg(F.count("*").alias("ways"), F.min("_p").alias("_f"))
    return t.join(g, "target", "left").select("target", F.when(F.col("ways") == 1, F.col("_f")).alias("fixed"), F.coalesce("ways", F.lit(0)).alias("ways"))


def longest_host(urls: DataFrame, host: str, rest: str, table: DataFrame) -> DataFrame:
    """`urls` with the `prefix` and `place` of the longest host table entry (host, prefix, place) that the address begins with.

    Hosts meet by equality, so only the prefixes of one host are compared with one address.
    """
    t = table.select(F.col("host").alias("_h"), F.coalesce("prefix", F.lit("")).alias("prefix"), "place")
    d = urls.withColumn("_id", F.xxhash64(host, rest)).join(t, (F.col(host) == F.col("_h")) & F.col(rest).startswith(F.col("prefix")), "left")
    w = Window.partitionBy(host, rest).orderBy(F.length("prefix").desc_nulls_last(), "prefix")
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_h", "_id")


def query_key(query: Column) -> Column:
    """A query's pairs in sorted order, so that order does not matter."""
    return F.array_join(F.array_sort(F.split(F.coalesce(query, F.lit("")), "&", -1)), "&")
