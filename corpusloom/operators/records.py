"""Operators on record tables: best version per key, overrides with guards, merge plans, carry-forward, unique slugs, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.bounded import checkpointed


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; order must settle ties."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered within their key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """(`df` with its rows numbered from 0 in a total order, how many there are), each range of the order in a task of its own."""
    ranges = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranges.groupBy("_part").count().orderBy("_part").collect()  # one row a partition
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_part"], before))
        before += r["count"]
    o = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    w = Window.partitionBy("_part").orderBy(*order)
    d = ranges.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(o), "_part")
    return d.withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_part", "_before", "_rn"), before


def in_ranges(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """`df` with `_part`, cut into ranges of the total order by key and `order`: a key of many rows lies in several ranges, in order."""
    return checkpointed(df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("_part", F.spark_partition_id()))


def _across(parts: DataFrame, key: list[str], made: Column, name: str) -> DataFrame:
    """(_k*, _q, name): what `made` makes of the parts of a key before (or behind) each part, where it makes something.

    Only keys that lie in several ranges have such rows, so there are at most as many as ranges.
    """
    w = parts.withColumn(name, made).where(F.col(name).isNotNull())
    return w.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_q"), name)


def _met(df: DataFrame, across: DataFrame, key: list[str]) -> DataFrame:
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(across, same, "left").drop("_q", *[f"_k{i}" for i in range(len(key))])


def numbered_within(ranges: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows of `in_ranges` numbered from 1 within their key; each range is numbered by itself and offset by those before it."""
    counts = ranges.groupBy("_part", *key).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    d = ranges.withColumn(name, F.row_number().over(Window.partitionBy("_part", *key).orderBy(*order)))
    return _met(d, _across(counts, key, before, "_before"), key).withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("int")).drop("_before")


def carried(df: DataFrame, key: list[str], order: list[Column], value: str, span: str | None = None) -> DataFrame:
    """`value` filled from the last row before that has one; with `span`, only for that many rows from its holder.

    A key is carried range by range, and what the ranges before it hold last comes in from their small table, so no key
    is one task's.
    """
    d = numbered_within(in_ranges(df, key, order), key, order, "_n")
    holder = F.when(F.col(value).isNotNull(), F.struct("_n", F.col(value).alias("v"), (F.col(span) if span else F.lit(None).cast("int")).alias("s")))
    d = d.withColumn("_own", holder)
    ends = d.groupBy("_part", *key).agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_n"))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_h", F.last("_own", ignorenulls=True).over(Window.partitionBy("_part", *key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    d = _met(d, _across(ends, key, earlier, "_earlier"), key).withColumn("_h", F.coalesce("_h", "_earlier"))
    near = F.lit(True) if span is None else (F.col("_n") - F.col("_h._n") < F.coalesce(F.col("_h.s"), F.lit(1)))
    return d.withColumn(f"{value}_carried", F.when(near, F.col("_h.v"))).drop("_n", "_h", "_own", "_earlier", "_part")


def filled_back(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """`value` filled from the next row behind that has one, key by key in ranges as in `carried`."""
    d = in_ranges(df, key, order)
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *key).orderBy(*order)))
    starts = d.groupBy("_part", *key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_n"))).alias("_start"))
    later = F.first("_start", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_part").rowsBetween(1, Window.unboundedFollowing))
    own = F.first(value, ignorenulls=True).over(Window.partitionBy("_part", *key).orderBy("_n").rowsBetween(0, Window.unboundedFollowing))
    d = _met(d.withColumn("_f", own), _across(starts, key, later, "_later"), key)
    return d.withColumn(f"{value}_filled", F.coalesce("_f", "_later")).drop("_n", "_f", "_later", "_part")


def collision_suffix(df: DataFrame, key: list[str], base: Column, suffix: Column, name: str) -> DataFrame:
    """`base` for keys held by one row, base and suffix for every row of keys held by several.

    Keys are counted map-side and joined back, nulls alike, so no key's rows meet in one task.
    """
    n = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = df.withColumn("_base", base).withColumn("_suffix", suffix).join(n, same, "left")
    d = d.withColumn(name, F.when(F.col("_n").isNotNull(), F.concat("_base", F.lit("+"), F.coalesce("_suffix", F.lit("")))).otherwise(F.col("_base")))
    return d.drop("_n", "_base", "_suffix", *[f"_k{i}" for i in range(len(key))])


def unique_slugs(df: DataFrame, base: str, order: list[str], sure: str) -> DataFrame:
    """`slug`: base, base-2, base-3 ... in order, confirmed rows first, never one that is another row's base.

    Rows of a base are numbered; a number that makes a slug which exists as a base is skipped by shifting past all such
    numbers, so the result is settled without a driver loop.
    """
    by = [F.col(sure).desc(), *[F.col(c) for c in order]]
    d = numbered_within(in_ranges(df, [base], by), [base], by, "_n").drop("_part")
    taken = (
        df.select(F.regexp_extract(base, r"^(.*)-(\d+)$", 1).alias("_b"), F.regexp_extract(base, r"^(.*)-(\d+)$", 2).try_cast("int").alias("_k"))
        .where("_b <> '' and _k >= 2").distinct().groupBy("_b").agg(F.array_sort(F.collect_list("_k")).alias("_taken"))
    )
    d = d.join(taken, d[base] == taken["_b"], "left")
    shifted = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda n, k: F.when((n >= 2) & (k <= n), n + 1).otherwise(n))
    return d.withColumn("slug", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), shifted))).drop("_n", "_b", "_taken")


def overridden(df: DataFrame, rules: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with overrides applied, report of rules).

    rules(key, field, value, expect): a rule applies where exactly one row has its key; a mismatch with `expect` is
    reported and applied all the same. The report gives changed, already, missing or ambiguous for each rule.
    """
    n = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("_rows"))
    judged = rules.join(n, "key", "left")
    good = judged.where("_rows = 1").groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("_set"))
    joined = df.join(good, df[key] == good["key"], "left").drop(good["key"])
    new = {f: F.coalesce(F.try_element_at("_set", F.lit(f)), F.col(f).cast("string")) for f in fields}
    changes = F.array_compact(F.array(*[F.when(~new[f].eqNullSafe(F.col(f).cast("string")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("from"), new[f].alias("to"))) for f in fields]))
    out = joined.withColumn("overrides_applied", changes).withColumns({f: new[f].cast(df.schema[f].dataType) for f in fields}).drop("_set")
    flat = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("held")) for f in fields])).alias("_f")).select("key", "_f.*")
    report = judged.join(flat, ["key", "field"], "left").select(
        "key", "field",
        F.when(F.col("_rows").isNull(), "missing").when(F.col("_rows") > 1, "ambiguous").when(F.col("held").eqNullSafe(F.col("value")), "already").otherwise("changed").alias("outcome"),
        (F.col("expect").isNotNull() & ~F.col("held").eqNullSafe(F.col("expect"))).alias("mismatch"),
    ).distinct()
    return out, report


def content_hash(columns: list[str]) -> Column:
    """Hash of a row's content, nulls told from empty strings."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]))


def merge_plan(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): create, update, skip or keep (only in `old`) for each key. Old rows edited by hand (manual) are manual."""
    n = new.select(F.col(key).alias("key"), content_hash(columns).alias("_new"))
    o = old.select(F.col(key).alias("key"), content_hash(columns).alias("_old"), (F.col("manual") if "manual" in old.columns else F.lit(False)).alias("_manual"))
    return n.join(o, "key", "full_outer").select(
        "key", F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "keep").when(F.col("_new") == F.col("_old"), "skip").when(F.col("_manual"), "manual").otherwise("update").alias("action")
    )


def section_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new(key, value, status): confirmed old rows stay, stale where no longer proposed; others are made again."""
    o = old.where("status = 'confirmed'").select(F.col(key), F.col("value").alias("_v"))
    return o.join(new.select(F.col(key), F.col("value").alias("_w")), key, "full_outer").select(
        key, F.coalesce("_v", "_w").alias("value"), F.when(F.col("_v").isNull(), "candidate").when(F.col("_w").isNull(), "stale").otherwise("confirmed").alias("status")
    )


def replaced(table: DataFrame, added: DataFrame, scope: str, value: str) -> DataFrame:
    """The table with the rows of one scope replaced, columns of either side kept."""
    return table.where(~F.col(scope).eqNullSafe(F.lit(value))).unionByName(added, allowMissingColumns=True)


def prefix_matches(paths: DataFrame, path: str, rules: DataFrame, rule: str) -> DataFrame:
    """`paths` with the longest rule that is the path itself, a directory above it or, ending in *, its beginning.

    Every prefix length that occurs among the rules makes one equi-join key, so no rule is compared with every path.
    """
    r = rules.select(F.col(rule).alias("_rule"), F.regexp_replace(rule, r"\*$", "").alias("_stem"), F.col(rule).endswith("*").alias("_open")).where("_stem <> ''").distinct()
    lengths = r.select(F.length("_stem").alias("l")).distinct()
    ls = [x[0] for x in lengths.orderBy("l").collect()]  # one row a length, so no more than the longest rule has letters
    keys = paths.withColumn("_key", F.explode(F.filter(F.array(*[F.lit(x) for x in ls]) if ls else F.array().cast("array<int>"), lambda n: n <= F.length(path)))).withColumn("_stem", F.substring(F.col(path), F.lit(1), F.col("_key")))
    hit = keys.join(r, "_stem").where(F.col("_open") | (F.col("_stem") == F.col(path)) | (F.substring(F.col(path), F.length("_stem") + 1, F.lit(1)) == "/"))
    w = Window.partitionBy(path).orderBy(F.length("_stem").desc(), "_rule")
    return hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*paths.columns, F.col("_rule").alias("rule"))


def checks(bundle: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(name, ok, detail) of named counts: each item is a name, a one-row frame and a column of it that tells whether all is well."""
    from functools import reduce

    rows = [df.select(F.lit(name).alias("name"), ok.alias("ok"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("detail")) for name, df, ok in bundle]
    return reduce(DataFrame.unionByName, rows)


def missing(c: Column, kind: str) -> Column:
    """Whether a field holds nothing: null, an empty string or an empty array."""
    return c.isNull() | ((F.size(c) == 0) if kind == "array" else (c == ""))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent with two places, nought of nothing."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2), F.lit(0.0))


def public(df: DataFrame) -> DataFrame:
    """`df` without the columns whose names begin with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def exclusion(duplicate: Column, view: Column, template: Column, title_page: Column, empty: Column) -> Column:
    """The first reason that holds to leave a file out; null where none does. Nulls hold no reason."""
    reasons = [("duplicate-of-catalogued", duplicate), ("cgi-view", view), ("site-template", template), ("title-page", title_page), ("empty", empty)]
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons])


def first_few(df: DataFrame, key: list[str], value: str, most: int) -> DataFrame:
    """(key, n, few): how many rows a key has and its first `most` values in order; no more than those are gathered.

    Values are ranked before they are gathered, so a key of any size costs its sort alone.
    """
    d = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(value)))
    n = d.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= most, F.col(value)))).alias("few"))
    return n.select(*key, "n", "few")


def proposals(members: DataFrame, work: str, family: str, order: str) -> DataFrame:
    """(work, family, n, proposal): of a work's families the largest, then the first, stays; others of two or more split off, single ones go alone."""
    g = members.groupBy(work, family).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    r = g.withColumn("_rn", F.row_number().over(Window.partitionBy(work).orderBy(F.desc("n"), F.col("_first").asc_nulls_last(), family)))
    return r.select(work, family, "n", F.when(F.col("_rn") == 1, "keep").when(F.col("n") >= 2, "split").otherwise("detach").alias("proposal"))


def merged_works(works: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works with `work`, the work each now belongs to; rules(merge, into) that do not hold, with the reason).

    A rule holds if both works are there, differ, share their author, and the one merged into is not merged itself.
    """
    known = works.groupBy("work_slug").agg(F.min("author_slug").alias("_by"))
    r = rules.distinct().join(known.select(F.col("work_slug").alias("merge"), F.col("_by").alias("_a")).withColumn("_m", F.lit(True)), "merge", "left").join(known.select(F.col("work_slug").alias("into"), F.col("_by").alias("_b")).withColumn("_i", F.lit(True)), "into", "left")
    chained = rules.select(F.col("merge").alias("into"), F.lit(True).alias("_c")).distinct()
    twice = rules.groupBy("merge").agg((F.min("into") != F.max("into")).alias("_t"))
    r = r.join(chained, "into", "left").join(twice, "merge", "left")
    reason = (
        F.when(F.col("merge") == F.col("into"), "itself").when(F.col("_m").isNull() | F.col("_i").isNull(), "missing").when(F.col("_c"), "chain").when(F.col("_t"), "twice").when(~F.col("_a").eqNullSafe(F.col("_b")), "author")
    )
    judged = r.select("merge", "into", reason.alias("reason"))
    good = judged.where("reason is null").select(F.col("merge").alias("work_slug"), "into").distinct()
    out = works.join(good, "work_slug", "left").withColumn("work", F.coalesce("into", "work_slug")).drop("into")
    return out, judged.where("reason is not null")


def regrouped(members: DataFrame, splits: DataFrame, detached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(work, member) after splits(member, title) and detached(member): (members with `work`, rules that do not hold).

    A split goes to a new work of its title under the old one, a detached member to a work of its own. A rule holds if
    its member is there and no other rule has it; a split needs a title.
    """
    rules = splits.select("member", F.lit("split").alias("rule"), "title").unionByName(detached.select("member", F.lit("detach").alias("rule"), F.lit(None).cast("string").alias("title"))).distinct()
    n = rules.groupBy("member").agg(F.count("*").alias("_n"))
    there = members.select("member", F.lit(True).alias("_there")).distinct()
    judged = rules.join(n, "member").join(there, "member", "left").withColumn("reason", F.when(F.col("_there").isNull(), "missing").when(F.col("_n") > 1, "twice").when((F.col("rule") == "split") & F.coalesce(F.trim("title") == "", F.lit(True)), "no title"))
    good = judged.where("reason is null").select("member", "rule", "title")
    work = F.when(F.col("rule") == "split", F.concat("work", F.lit("/"), "title")).when(F.col("rule") == "detach", F.concat("work", F.lit("/="), F.col("member").cast("string"))).otherwise(F.col("work"))
    return members.join(good, "member", "left").select("member", work.alias("work")), judged.where("reason is not null").select("member", "rule", "reason")


def edited(modified: Column, loaded: Column, slack: str = "interval 2 seconds") -> Column:
    """Whether a row was changed by hand after it was loaded."""
    return modified > loaded + F.expr(slack)


def page_file(title: Column, content: Column) -> Column:
    """A page as a file: its title in a comment, its content, one line end."""
    return F.concat(F.lit("<!-- title: "), title, F.lit(" -->\n"), F.regexp_replace(content, r"[\r\n]+$", ""), F.lit("\n"))


def read_page_file(page: Column) -> Column:
    """struct<title, content> of such a file."""
    return F.struct(F.regexp_extract(page, r"^<!-- title: (.*?) -->\n", 1).alias("title"), F.regexp_replace(F.regexp_replace(page, r"^<!-- title: .*? -->\n", ""), r"\n$", "").alias("content"))


def visible(status: Column, hidden: Column, can_view_hidden: Column) -> Column:
    """pass, gone (withdrawn), show_hidden or not_found for a reader of a row."""
    return F.when(status == "withdrawn", "gone").when(hidden & can_view_hidden, "show_hidden").when(hidden, "not_found").otherwise("pass")
