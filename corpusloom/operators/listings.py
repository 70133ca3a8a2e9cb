"""Pages of a catalogue as rows: regular entry tables, flat and tabular lists of older makes, recommendations, notices.

A page that breaks the layout gives failures beside its entries and never stops the others. The markup is one long line
with broken nesting, so everything is found by flat patterns; case does not matter.

Defined results: null pages and pages without entries give no rows; missing fields are null, missing lists empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.parsers import sizes

# The markers of an entry's fields.
MARKERS = {"arasuji": "あらすじ", "comment": "コメント", "suisen": "推薦文", "genre": "ジャンル", "type": "種別", "keywords": "キーワード"}
ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))[^>]*>(.*?)</a\s*>"
_TRIM = r"(?U)^[\s　]+|[\s　]+$"


def anchors(s: Column) -> Column:
    """array<struct<href, label, place>> of the links of a text in order; place is where the link begins, from 1.

    A link runs to its own end tag; the text of a link inside a broken one counts for the outer link.
    """
    found = F.regexp_extract_all(s, F.lit(ANCHOR.replace("(?is)", "(?is)(", 1) + ")"), 1)
    part = lambda a, i: F.regexp_extract(a, ANCHOR, i)
    made = F.transform(
        found,
        lambda a: F.struct(
            F.concat(part(a, 1), part(a, 2), part(a, 3)).alias("href"),
            text.null_if_empty(F.regexp_replace(F.regexp_replace(F.regexp_replace(part(a, 4), "<[^>]+>", ""), r"(?U)[\s　]+", " "), _TRIM, "")).alias("label"),
            a.alias("_a"),
        ),
    )
    # each link is sought behind the one before it
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<href:string,label:string,place:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (F.position(x["_a"], s, acc["from"]) + F.length(x["_a"])).cast("int").alias("from"),
        F.concat(acc["out"], F.array(F.struct(x["href"].alias("href"), x["label"].alias("label"), F.position(x["_a"], s, acc["from"]).cast("int").alias("place")))).alias("out"),
    )
    return F.aggregate(made, start, step)["out"]


def is_nav(label: Column) -> Column:
    """Whether a link's label is one of the 【…】 kind."""
    return F.coalesce(label.rlike("(?s)^【.+】$"), F.lit(False))


def marker_value(cell: Column, name: str, bold: bool = True) -> Column:
    """What follows 【name】 up to the next marker, a bold one or any; null without the marker."""
    stop = r"<B>\s*【" if bold else "【"
    hit = F.regexp_extract(cell, rf"(?is)【{name}】(?:\s*</B>)?(.*?)(?:{stop}|$)", 1)
    return F.when(cell.contains(f"【{name}】"), hit)


def without_nav(cell: Column) -> Column:
    """A cell without its 【…】 links."""
    return F.regexp_replace(cell, r"(?is)<a\b[^>]*>\s*(?:<[^>]+>\s*)*【[^】]+】\s*(?:<[^>]+>\s*)*</a\s*>", "")


def shown(cell: Column) -> Column:
    """The text of a cell without navigation and tags, blanks collapsed; empty is null."""
    return text.null_if_empty(F.regexp_replace(F.regexp_replace(F.regexp_replace(without_nav(cell), "<[^>]+>", ""), r"(?U)[\s　]+", " "), _TRIM, ""))


def author_cell(cell: Column) -> Column:
    """struct<author, homepage>: the bold name without さん, and the link labelled Homepage."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(cell, r"(?is)<B>(.*?)</B>", 1), "<[^>]+>", ""), _TRIM, ""), r"\s*さん$", "")
    home = F.filter(F.transform(F.regexp_extract_all(cell, F.lit(ANCHOR.replace("(?is)", "(?is)(", 1) + ")"), 1), lambda a: a), lambda a: F.regexp_extract(a, ANCHOR, 4).rlike("(?i)homepage"))
    first = F.get(home, F.lit(0))
    return F.struct(text.null_if_empty(name).alias("author"), text.null_if_empty(F.concat(*[F.regexp_extract(first, ANCHOR, i) for i in (1, 2, 3)])).alias("homepage"))


def illustrators(cell: Column) -> Column:
    """Names behind 画( in bold, titles off."""
    inner = F.regexp_extract(cell, r"(?is)画\s*[(（].*?<B>(.*)</B>", 1)
    names = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"(?is)[(（]<a.*?</a>[)）]", ""), "<[^>]+>", ""), r"[(（].*$", ""), "[、,，]", -1)
    return F.filter(F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(n, _TRIM, ""), "さん$", "")), lambda n: n != "")


def regular(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, failure, entry): the bordered tables of a page, each of four rows with six cells in the first, or why not."""
    d = pages.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<table\b[^>]*\bborder\s*=\s*[\"']?1\b.*?</table\s*>)"), 1)).alias("_i", "_t"))
    rows = F.regexp_extract_all("_t", F.lit(r"(?is)(<tr\b.*?)(?=<tr\b|</table)"), 1)
    d = d.select("key", (F.col("_i") + 1).alias("n"), rows.alias("_r"))
    cells = F.regexp_extract_all(F.get("_r", F.lit(0)), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]|</tr|$)"), 1)
    d = d.withColumn("_c", cells)
    ref = F.concat(F.col("key").cast("string"), F.lit("#"), F.col("n"))
    failure = F.when(F.size("_r") != 4, F.concat(ref, F.lit(": expected 4 rows, got "), F.size("_r"))).when(F.size("_c") != 6, F.concat(ref, F.lit(": expected 6 cells, got "), F.size("_c")))
    cell = lambda i: F.get("_c", F.lit(i))
    row = lambda i: F.get("_r", F.lit(i))
    link = F.regexp_extract(cell(0), ANCHOR.replace("(?is)", "(?is)(", 1) + ")", 1)
    day = F.regexp_extract(cell(3), r"(\d{4})/(\d{1,2})/(\d{1,2})", 0)
    who = author_cell(cell(1))
    size = sizes(cell(4))
    tokens = lambda name: F.coalesce(text.split_tokens(F.regexp_replace(marker_value(row(3), name, bold=False), "<[^>]+>", "")), F.array().cast("array<string>"))
    entry = F.struct(
        shown(cell(0)).alias("title"),
        text.null_if_empty(F.concat(*[F.regexp_extract(link, ANCHOR, i) for i in (1, 2, 3)])).alias("href"),
        who["author"].alias("author"),
        who["homepage"].alias("homepage"),
        illustrators(cell(2)).alias("illustrators"),
        F.date_format(F.try_make_timestamp(F.split_part(day, F.lit("/"), F.lit(1)).try_cast("int"), F.split_part(day, F.lit("/"), F.lit(2)).try_cast("int"), F.split_part(day, F.lit("/"), F.lit(3)).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)), "yyyy-MM-dd").alias("date"),
        text.null_if_empty(F.regexp_extract(cell(3), r"[（(]([月火水木金土日])[）)]", 1)).alias("weekday"),
        size["kb"].alias("size_kb"),
        size["files"].alias("files_n"),
        text.null_if_empty(F.regexp_extract(cell(5), r"(?i)kansou/([\w\-]+)", 1)).alias("kansou_slug"),
        shown(marker_value(row(1), MARKERS["arasuji"])).alias("arasuji"),
        shown(marker_value(row(2), MARKERS["comment"])).alias("comment"),
        F.filter(anchors(F.coalesce(row(1), F.lit(""))), lambda a: is_nav(a["label"])).alias("nav_links"),
        tokens(MARKERS["genre"]).alias("genre"),
        tokens(MARKERS["keywords"]).alias("keywords"),
        ref.alias("catalog_ref"),
    )
    return d.select("key", "n", failure.alias("failure"), F.when(failure.isNull(), entry).alias("entry"))


def recommendations(s: Column) -> Column:
    """struct<recommender, refs array<struct<href, title, author, inherited>>> of 【…さんのオススメ作品】; null without the heading.

    A link without an author of its own takes the one named behind the next link that has one.
    """
    head = F.regexp_extract(s, r"【([^【】]*?)さんのオススメ作品】", 1)
    found = F.regexp_extract_all(s, F.lit(r"(?is)(<a\b[^>]*\bhref.*?</a\s*>(?:[^<]*?[（(][^（()）]*?さん作[)）])?)"), 1)
    refs = F.transform(
        found,
        lambda a: F.struct(
            F.concat(*[F.regexp_extract(a, ANCHOR, i) for i in (1, 2, 3)]).alias("href"),
            F.regexp_replace(F.regexp_replace(F.regexp_extract(a, ANCHOR, 4), "<[^>]+>", ""), "[『』]", "").alias("title"),
            text.null_if_empty(F.regexp_extract(a, r"[（(]([^（()）]*?)さん作[)）]$", 1)).alias("author"),
        ),
    )
    # walked from the end, so each link sees the author behind it
    none = F.array().cast("array<struct<href:string,title:string,author:string,inherited:boolean>>")
    back = F.aggregate(
        F.reverse(refs),
        F.struct(F.lit(None).cast("string").alias("a"), none.alias("out")),
        lambda acc, r: F.struct(
            F.coalesce(r["author"], acc["a"]).alias("a"),
            F.concat(F.array(F.struct(r["href"].alias("href"), r["title"].alias("title"), F.coalesce(r["author"], acc["a"]).alias("author"), (r["author"].isNull() & acc["a"].isNotNull()).alias("inherited"))), acc["out"]).alias("out"),
        ),
    )["out"]
    return F.when(s.contains("さんのオススメ作品】"), F.struct(head.alias("recommender"), back.alias("refs")))


def notice(s: Column) -> Column:
    """struct<author, kind, date_raw> of a note that a work was taken down at its author's wish; null for other texts."""
    p = r"作者である(.+?)さんの(?:要望|希望)により(公開を停止|掲載を終了|削除)しました(?:[。、]?[（(]?(\d{4}年\d{1,2}月\d{1,2}日))?"
    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("author"), F.regexp_extract(s, p, 2).alias("kind"), F.regexp_extract(s, p, 3).alias("date_raw")))


def flat(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, failure, title, href, author, date, precision, size_kb, commented_out) of flat pages: lines of a link,
    （author）, month/day and KB, some of them inside comments; the years come from the range in the page's heading.

    A page without a range is one failure.
    """
    from corpusloom.operators.parsers import resolved_year

    span = r"[(（](\d{4})\.(\d{1,2})\.(\d{1,2})\s*-\s*(?:(\d{4})\.(\d{1,2})\.(\d{1,2}))?\s*[)）]"
    day = lambda i: F.try_make_timestamp(*[F.regexp_extract(html, span, j).try_cast("int") for j in (i, i + 1, i + 2)], F.lit(0), F.lit(0), F.lit(0)).cast("date")
    d = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), day(1).alias("_from"), F.coalesce(day(4), day(1) + F.expr("interval 1 year")).cast("date").alias("_to"), F.col(html).alias("_h"))
    marked = F.regexp_replace("_h", r"(?s)<!--(.*?)-->", "\n\u0001$1\n")
    lines = F.filter(F.split(marked, r"(?i)\n|<br\s*/?>", -1), lambda x: x.rlike(r"(?i)<a\b[^>]*href"))
    bad = d.where("_from is null").select("key", F.lit(0).alias("n"), F.concat(F.col("key").cast("string"), F.lit(": page range not found")).alias("failure"))
    e = d.where("_from is not null").select("key", "_from", "_to", F.posexplode(lines).alias("_i", "_l"))
    when = r"(\d{1,2})/(\d{1,2})(?!\d)"
    made = resolved_year(F.regexp_extract("_l", when, 1).try_cast("int"), F.regexp_extract("_l", when, 2).try_cast("int"), F.col("_from"), F.col("_to"))
    link = F.regexp_extract("_l", ANCHOR.replace("(?is)", "(?is)(", 1) + ")", 1)
    good = e.select(
        "key", (F.col("_i") + 1).alias("n"), F.lit(None).cast("string").alias("failure"),
        shown(link).alias("title"),
        text.null_if_empty(F.concat(*[F.regexp_extract(link, ANCHOR, i) for i in (1, 2, 3)])).alias("href"),
        text.null_if_empty(F.regexp_extract("_l", r"</a>\s*[（(]([^（()）]+?)(?:さん)?[)）]", 1)).alias("author"),
        F.date_format(made["date"], "yyyy-MM-dd").alias("date"), made["precision"].alias("precision"),
        sizes(F.col("_l"))["kb"].alias("size_kb"), F.col("_l").startswith("\u0001").alias("commented_out"),
    )
    return good.unionByName(bad, allowMissingColumns=True)


def tabular(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, title, author, role, note, genre): blocks between *** lines of a page; a block whose author is *** is a notice."""
    d = pages.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table\s*>)"), 1)).alias("_i", "_t"))
    field = lambda name: text.null_if_empty(F.regexp_replace(F.regexp_replace(F.regexp_extract("_t", rf"(?is)<t[dh][^>]*>\s*{name}\s*</t[dh]>\s*<td[^>]*>(.*?)(?:</td|<tr|</table)", 1), "<[^>]+>", ""), _TRIM, ""))
    d = d.select("key", (F.col("_i") + 1).alias("n"), field("題名").alias("title"), field("作者").alias("_a"), field("分類").alias("genre"), field("内容").alias("note"))
    told = F.coalesce(F.col("_a").rlike(r"^\*{3,}$"), F.lit(False)) & F.col("genre").isNull()
    return d.select("key", "n", "title", F.when(~told, F.regexp_replace("_a", "さん$", "")).alias("author"), F.when(told, "notice").otherwise("work").alias("role"), "note", F.coalesce(text.split_tokens(F.col("genre")), F.array().cast("array<string>")).alias("genre"))
