"""Semi-structured text as rows: commit logs, table rows with spans, catalogue entries, document references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commit_log(lines: DataFrame, value: str, order: str, chunk: str | None = None) -> DataFrame:
    """(commit, epoch, subject, path): file lines of a log under the header `__C__hash|epoch|subject` above them.

    `order` settles the order of the lines. With `chunk`, a column whose groups each begin with a header (a file of a log
    cut at headers, or a commit's own number), every chunk is read by itself; one unbroken log is read in one task.
    """
    w = (Window.partitionBy(chunk) if chunk else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col(value).startswith("__C__"), F.split(F.substring(F.col(value), 6, 1_000_000), r"\|", 3))
    d = lines.withColumn("_h", F.last(head, ignorenulls=True).over(w)).where(f"not startswith({value}, '__C__') and trim({value}) <> ''")
    return d.select(F.col("_h")[0].alias("commit"), F.col("_h")[1].try_cast("long").alias("epoch"), F.col("_h")[2].alias("subject"), F.col(value).alias("path"))


def first_commits(log: DataFrame) -> DataFrame:
    """(path, commit, epoch) of each path's first commit."""
    return log.groupBy("path").agg(F.min_by(F.struct("commit", "epoch"), F.struct("epoch", "commit")).alias("f")).select("path", "f.commit", "f.epoch")


def cells(row: Column) -> Column:
    """Texts of the cells of a table row."""
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</tr|$)"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"(?U)\s+", " ")))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, cells, span): the rows of all tables, with the row span that the first cell opens."""
    rows = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<tr\b.*?)(?=<tr\b|</table|$)"), 1)).alias("n", "_r"))
    span = F.regexp_extract("_r", r"(?is)^<tr\b[^>]*>\s*<t[dh]\b[^>]*rowspan\s*=\s*[\"']?(\d+)", 1).try_cast("int")
    return rows.select(key, "n", cells(F.col("_r")).alias("cells"), span.alias("span"))


def headed_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, heading, line): lines of a page under the last h2 before them."""
    marked = F.regexp_replace(F.regexp_replace(html, r"(?is)<h2\b[^>]*>(.*?)</h2\s*>", "\n\u0001$1\n"), r"(?i)<(?:br|/?p|/?div|/?li|/?tr)\b[^>]*>", "\n")
    flat = F.split(F.regexp_replace(marked, "<[^>]+>", ""), "\n", -1)
    rows = pages.select(F.col(key), F.posexplode(flat).alias("n", "_l")).withColumn("_l", F.trim("_l")).where("_l <> ''")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("_l").startswith("\u0001"), F.substring("_l", 2, 1_000_000)), ignorenulls=True).over(w)
    return rows.withColumn("heading", head).where(~F.col("_l").startswith("\u0001")).select(key, "n", "heading", F.col("_l").alias("line"))


def sizes(text: Column) -> Column:
    """struct<kb, files> of a size note such as `12 KB / 3 FILES`."""
    return F.struct(
        F.regexp_extract(text, r"(?i)(\d+)\s*KB", 1).try_cast("int").alias("kb"), F.regexp_extract(text, r"(?i)(\d+)\s*FILES?", 1).try_cast("int").alias("files")
    )


def credits(text: Column) -> Column:
    """struct<author, illustrators>: 作・A / 画・B、C."""
    author = F.regexp_extract(text, r"作[・:：]\s*([^/／]+)", 1)
    art = F.regexp_extract(text, r"画[・:：]\s*([^/／]+)", 1)
    return F.struct(
        F.when(F.trim(author) != "", F.trim(author)).alias("author"),
        F.filter(F.transform(F.split(art, "[、,，]", -1), lambda x: F.trim(F.regexp_replace(x, r"[(（].*$", ""))), lambda x: x != "").alias("illustrators"),
    )


def banned_lines(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, line_no, word) of lines that hold one of the words."""
    rows = docs.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("_n", "_l"))
    hit = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("_l"), w))
    return rows.withColumn("_w", hit).where(F.size("_w") > 0).select(key, (F.col("_n") + 1).alias("line_no"), F.explode("_w").alias("word"))


def denied_paths(lines: DataFrame, value: str) -> DataFrame:
    """(path, whole) of the lines of a server's rules that deny something: gone redirects and rewrites to nothing.

    whole tells a path that is denied by itself from the beginning of many; comments and other rules say nothing.
    """
    v = F.trim(F.col(value))
    gone = r"(?i)^Redirect(?:Match)?\s+(?:gone|410)\s+(\S+)\s*$"
    rule = r"(?i)^RewriteRule\s+(\S+)\s+-\s+\[[^\]]*\b(?:G|F)\b[^\]]*\]\s*$"
    raw = F.when(v.rlike(gone), F.regexp_extract(v, gone, 1)).when(v.rlike(rule), F.regexp_extract(v, rule, 1))
    d = lines.select(raw.alias("_p")).where("_p is not null")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("_p", r"^\^?/?", ""), r"\$$", ""), r"\\(.)", "$1")
    whole = F.col("_p").endswith("$") | ~F.col("_p").startswith("^")
    return d.select(path.alias("path"), whole.alias("whole")).distinct()


def secret_lines(docs: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """(key, line_no, rule) of lines that meet a rule's pattern; what they hold stays where it is."""
    rows = docs.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("_n", "_l"))
    met = F.array_compact(F.array(*[F.when(F.col("_l").rlike(p), F.lit(name)) for name, p in rules.items()]))
    return rows.select(key, (F.col("_n") + 1).alias("line_no"), F.explode(met).alias("rule"))


def resolved_year(month: Column, day: Column, start: Column, end: Column) -> Column:
    """struct<date, precision> of a month and day without year inside a page's range of days.

    exact when just one year puts the day into the range, ambiguous when the range spans twelve months or more,
    clamped to the range's nearer end when none does.
    """
    years = F.sequence(F.year(start), F.year(end))
    days = F.filter(F.transform(years, lambda y: F.try_make_timestamp(y, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")), lambda d: d.isNotNull())
    inside = F.filter(days, lambda d: d.between(start, end))
    return F.struct(
        F.when(F.size(inside) > 0, inside[0]).when(F.size(days) > 0, F.greatest(start, F.least(end, days[0]))).alias("date"),
        F.when(F.size(inside) > 1, "range-ambiguous").when(F.size(inside) == 1, "range-derived").when(F.size(days) > 0, "range-clamped").otherwise("unknown").alias("precision"),
    )
