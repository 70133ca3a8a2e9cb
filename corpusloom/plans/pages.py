"""Queries of page parsing and body conversion.

The tables hold no pages, so each query writes a page for every row out of the row's own fields, reads it back with the
operator, and the SQL says what must come out. Fields go through `solid`, which keeps letters and digits, so that a
page's markup is all the query's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import markup, text
from corpusloom.operators import bodies, listings, parsers, versions
from corpusloom.plans.registry import registry
from corpusloom.sources.tables import table

QUERIES, SQL, query = registry()

_NOT_SOLID = "[^0-9A-Za-zぁ-んァ-ヶー一-龠々]+"


def solid(c: str) -> Column:
    """Letters and digits of a field, empty for null."""
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), _NOT_SOLID, "")


def _s(c: str) -> str:
    return f"regexp_replace(coalesce({c}::VARCHAR, ''), '{_NOT_SOLID}', '', 'g')"


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").withColumns({"t": solid("title"), "a": solid("author"), "k": F.coalesce("kansou_slug", F.lit(""))})


_E = f"(SELECT *, {_s('title')} AS t, {_s('author')} AS a, coalesce(kansou_slug, '') AS k FROM episodes) e"


# ---- links and fragments


@query(f"""
SELECT entry_no, n, target FROM (SELECT entry_no, unnest([1, 2, 3, 4]) AS n, unnest([t || '.html', 'i/' || t || '.gif', t || '.html#p', 'b' || t]) AS target FROM {_E})
""")
def tvf01_links(spark: SparkSession, d: str) -> DataFrame:
    """Values of link attributes in double, single and no quotes."""
    page = _cat('<A HREF="', F.col("t"), ".html\">x</A><img src='i/", F.col("t"), ".gif'><a name=z href=", F.col("t"), '.html#p>y</a><body background="b', F.col("t"), '">')
    rows = _episodes(spark, d).select("entry_no", F.posexplode(markup.links(page)).alias("_n", "target"))
    return rows.select("entry_no", (F.col("_n") + 1).alias("n"), "target")


@query(f"""
SELECT entry_no, n, href, label, place FROM (SELECT entry_no, unnest([1, 2]) AS n, unnest([t || '.html', 'z' || a]) AS href, unnest([CASE WHEN t <> '' THEN t END, 'x' || a]) AS label,
  unnest([2, 23 + 2 * length(t)]) AS place FROM {_E})
""")
def tvf02_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Links with label and place."""
    page = _cat("前<a href='", F.col("t"), ".html'>", F.col("t"), "</a>中<A class=c HREF=z", F.col("a"), "><b>x", F.col("a"), "</b></A>後")
    rows = _episodes(spark, d).select("entry_no", F.posexplode(listings.anchors(page)).alias("_n", "x"))
    return rows.select("entry_no", (F.col("_n") + 1).alias("n"), "x.href", "x.label", "x.place")


@query(f"""
SELECT entry_no, ' ' || t || '【第2話】 ' AS arasuji, ' ' || a AS comment, NULL::VARCHAR AS suisen, ' ' || k || ' ' AS genre FROM {_E}
""")
def tvf03_sections(spark: SparkSession, d: str) -> DataFrame:
    """Fields behind bold markers, which plain ones do not end, and behind plain markers."""
    bold = _cat("<B>【あらすじ】</B> ", F.col("t"), "【第2話】 <B>【コメント】</B> ", F.col("a"))
    plain = _cat("【ジャンル】 ", F.col("k"), " 【種別】 短編")
    v = listings.marker_value
    return _episodes(spark, d).select("entry_no", v(bold, "あらすじ").alias("arasuji"), v(bold, "コメント").alias("comment"), v(bold, "推薦文").alias("suisen"), v(plain, "ジャンル", False).alias("genre"))


@query(f"""
SELECT entry_no, '前' || t || '後<a href="c.html">参考</a>' AS rest, 'b' || a || '.html' AS nav, 'c.html' AS inline, '前' || t || '後参考' AS shown FROM {_E}
""")
def tvf04_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Navigation links told from links in the text, and the text without them."""
    cell = _cat("前", F.col("t"), '<a href="b', F.col("a"), '.html">【第2話はこちら】</a>後<a href="c.html">参考</a>')
    links = listings.anchors(cell)
    one = lambda nav: F.array_join(F.transform(F.filter(links, lambda a: listings.is_nav(a["label"]) == F.lit(nav)), lambda a: a["href"]), ",")
    return _episodes(spark, d).select("entry_no", listings.without_nav(cell).alias("rest"), one(True).alias("nav"), one(False).alias("inline"), listings.shown(cell).alias("shown"))


_DAY = "strftime(DATE '2001-01-01' + (entry_no % 3000)::INTEGER, '%Y-%m-%d')"


@query(f"""
WITH e AS (SELECT *, entry_no // 5 AS page, row_number() OVER (PARTITION BY entry_no // 5 ORDER BY entry_no) AS n FROM {_E})
SELECT page, n, CASE WHEN title IS NULL THEN page || '#' || n || ': expected 4 rows, got 5' END AS failure, CASE WHEN title IS NOT NULL AND t <> '' THEN t END AS title,
  CASE WHEN title IS NOT NULL THEN 'novel/' || entry_no || '.html' END AS href, CASE WHEN title IS NOT NULL AND a <> '' THEN a END AS author,
  CASE WHEN title IS NOT NULL THEN 'h' || entry_no || '.html' END AS homepage, CASE WHEN title IS NOT NULL THEN '花子,' || 'B' || entry_no END AS illustrators,
  CASE WHEN title IS NOT NULL THEN {_DAY} END AS date, CASE WHEN title IS NOT NULL THEN size_kb END AS size_kb, CASE WHEN title IS NOT NULL THEN files_n END AS files_n,
  CASE WHEN title IS NOT NULL AND k <> '' THEN k END AS kansou_slug, CASE WHEN title IS NOT NULL THEN 'あら' || t END AS arasuji, CASE WHEN title IS NOT NULL THEN 'x' || entry_no || '.html' END AS nav,
  CASE WHEN title IS NOT NULL THEN 'g1,g' || entry_no END AS genre FROM e
""")
def tvf05_regular_pages(spark: SparkSession, d: str) -> DataFrame:
    """Entries of regular pages, five to a page, with the failures of broken ones."""
    no = F.col("entry_no").cast("string")
    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("entry_no") % 3000).cast("int")), "yyyy/M/d")
    size = F.concat(F.coalesce(F.concat(F.col("size_kb"), F.lit(" KB")), F.lit("")), F.lit(" / "), F.coalesce(F.concat(F.col("files_n"), F.lit(" FILES")), F.lit("")))
    more = F.when(F.col("title").isNull(), "<TR><TD>x</TD></TR>").otherwise("")
    entry = _cat(
        '<TABLE BORDER=1 width="90%"><TR><TD><a href="novel/', no, '.html"><B>', F.col("t"), "</B></a></TD><TD><B>", F.col("a"), ' さん</B> (<a href="h', no, '.html">Homepage</a>)</TD><TD>画(<B>花子(<a href="http://x.example/">Homepage</a>)、B', no,
        "さん</B>さん)</TD><TD>", day, "（土）</TD><TD>", size, '</TD><TD><a href="../kansou/', F.col("k"), '/">感想</a></TD></TR>', more, '<TR><TD><B>【あらすじ】</B> あら', F.col("t"), '<a href="x', no,
        '.html">【第2話はこちら】</a></TD></TR><TR><TD><B>【コメント】</B>こめ</TD></TR><TR><TD>【ジャンル】 g1　g', no, " 【種別】 短編</TD></TR></TABLE>",
    )
    pages = _episodes(spark, d).select(F.floor(F.col("entry_no") / 5).alias("page"), F.struct("entry_no", entry.alias("h")).alias("x")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n").alias("html"))
    e = listings.regular(pages, "page", "html")
    both = lambda c: F.array_join(f"entry.{c}", ",").alias(c)
    return e.select(
        F.col("key").alias("page"), "n", "failure", "entry.title", "entry.href", "entry.author", "entry.homepage", both("illustrators"), "entry.date", "entry.size_kb", "entry.files_n", "entry.kansou_slug", "entry.arasuji",
        F.array_join(F.transform("entry.nav_links", lambda x: x["href"]), ",").alias("nav"), both("genre"),
    )


@query(f"""
SELECT entry_no, n, 'r' || a AS recommender, 'x' || n || '.html' AS href, CASE n WHEN 1 THEN t || '１' WHEN 2 THEN '／２' ELSE 'z' END AS title, CASE WHEN n < 3 THEN 's' || k END AS author, n = 1 AS inherited
FROM (SELECT *, unnest([1, 2, 3]) AS n FROM (SELECT entry_no, t, a, regexp_replace(k, '{_NOT_SOLID}', '', 'g') AS k FROM {_E}))
""")
def tvf06_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Recommended works, the author of one link carried back to those before it."""
    cell = _cat("<B>【r", F.col("a"), 'さんのオススメ作品】</B> <a href="x1.html">『', F.col("t"), '１</a><a href="x2.html">／２』</a>（s', F.regexp_replace("k", _NOT_SOLID, ""), "さん作）と<a href='x3.html'>z</a>")
    r = listings.recommendations(cell)
    rows = _episodes(spark, d).select("entry_no", r["recommender"].alias("recommender"), F.posexplode(r["refs"]).alias("_n", "x"))
    return rows.select("entry_no", (F.col("_n") + 1).alias("n"), "recommender", "x.href", "x.title", "x.author", "x.inherited")


@query(f"""
WITH e AS (SELECT *, entry_no // 4 AS page, row_number() OVER (PARTITION BY entry_no // 4 ORDER BY entry_no) AS n, (entry_no // 4) % 7 = 0 AS broken FROM {_E})
SELECT page, CASE WHEN broken THEN 0 ELSE n END AS n, CASE WHEN broken THEN page || ': page range not found' END AS failure, CASE WHEN NOT broken AND t <> '' THEN t END AS title,
  CASE WHEN NOT broken THEN 'novel/' || entry_no || '.html' END AS href, CASE WHEN NOT broken THEN 'y' || a END AS author, CASE WHEN NOT broken THEN CASE WHEN entry_no % 2 = 0 THEN '1998-04-05' ELSE '1997-12-01' END END AS date,
  CASE WHEN NOT broken THEN CASE WHEN entry_no % 2 = 0 THEN 'range-derived' ELSE 'range-derived' END END AS precision, CASE WHEN NOT broken THEN size_kb END AS size_kb, CASE WHEN NOT broken THEN entry_no % 2 = 1 END AS commented_out
FROM e WHERE NOT broken OR n = 1
""")
def tvf07_flat_pages(spark: SparkSession, d: str) -> DataFrame:
    """Entries of flat pages, also those inside comments, with years from the page's range; pages without one fail."""
    no = F.col("entry_no").cast("string")
    line = _cat('<a href="novel/', no, '.html">', F.col("t"), "</a> （y", F.col("a"), "さん） ", F.when(F.col("entry_no") % 2 == 0, "4/5").otherwise("12/1"), " ", F.coalesce(F.concat(F.col("size_kb"), F.lit("KB")), F.lit("")), "<br>")
    line = F.when(F.col("entry_no") % 2 == 1, _cat("<!-- ", line, " -->")).otherwise(line)
    e = _episodes(spark, d).select(F.floor(F.col("entry_no") / 4).alias("page"), F.struct("entry_no", line.alias("h")).alias("x"))
    pages = e.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n").alias("_b"))
    pages = pages.select("page", F.concat(F.when(F.col("page") % 7 == 0, "旧作品").otherwise("旧作品(1997.11.4 - 1998.4.5)<br>"), "_b").alias("html"))
    return listings.flat(pages, "page", "html").select(F.col("key").alias("page"), "n", "failure", "title", "href", "author", "date", "precision", "size_kb", "commented_out")


@query(f"""
WITH e AS (SELECT *, entry_no // 3 AS page, row_number() OVER (PARTITION BY entry_no // 3 ORDER BY entry_no) AS n FROM {_E})
SELECT page, n, CASE WHEN t <> '' THEN t END AS title, CASE WHEN author IS NOT NULL AND a <> '' THEN a END AS author, CASE WHEN author IS NULL THEN 'notice' ELSE 'work' END AS role, CASE WHEN k <> '' THEN k END AS note,
  CASE WHEN author IS NULL THEN '' ELSE 'g' || entry_no || ',h' END AS genre FROM e
""")
def tvf08_table_pages(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of table pages; those without an author and a class are notices."""
    no = F.col("entry_no").cast("string")
    who = F.when(F.col("author").isNull(), "***").otherwise(F.concat("a", F.lit("さん")))
    who = F.when(F.col("author").isNotNull() & (F.col("a") == ""), "").otherwise(who)
    kind = F.when(F.col("author").isNotNull(), _cat("<tr><th>分類</th><td>g", no, " h</td></tr>")).otherwise("")
    block = _cat("<table><tr><th>題名</th><td><b>", F.col("t"), "</b></td></tr><tr><th>作者</th><td>", who, "</td></tr>", kind, "<tr><th>内容</th><td>", F.col("k"), "</td></tr></table>")
    e = _episodes(spark, d).select(F.floor(F.col("entry_no") / 3).alias("page"), F.struct("entry_no", block.alias("h")).alias("x"))
    pages = e.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "***").alias("html"))
    return listings.tabular(pages, "page", "html").select(F.col("key").alias("page"), "n", "title", "author", "role", "note", F.array_join("genre", ",").alias("genre"))


@query(f"""
WITH e AS (SELECT *, entry_no // 6 AS page, row_number() OVER (PARTITION BY entry_no // 6 ORDER BY entry_no) - 1 AS n FROM {_E})
SELECT page, n, t || ',' || a AS cells, CASE WHEN entry_no % 3 = 0 THEN 2 END AS span FROM e
""")
def tvf09_index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of index tables with the span their first cell opens."""
    row = _cat("<tr><td", F.when(F.col("entry_no") % 3 == 0, " rowspan=2").otherwise(""), ">", F.col("t"), "</td><td>", F.col("a"), "</td></tr>")
    e = _episodes(spark, d).select(F.floor(F.col("entry_no") / 6).alias("page"), F.struct("entry_no", row.alias("h")).alias("x"))
    pages = e.groupBy("page").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ""), F.lit("</table>")).alias("html"))
    return parsers.table_rows(pages, "page", "html").select("page", "n", F.array_join("cells", ",").alias("cells"), "span")


@query(f"""
SELECT entry_no, n, heading, line FROM (SELECT entry_no, unnest([1, 3, 4]) AS n, unnest([NULL, 'h' || k, 'h' || k]) AS heading, unnest(['x', 't' || t, 'a' || a]) AS line FROM {_E})
""")
def win04_heading_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Lines under the heading before them."""
    page = _cat("<p>x<h2>h", F.col("k"), "</h2>t", F.col("t"), "<br>a", F.col("a"))
    rows = parsers.headed_lines(_episodes(spark, d).select("entry_no", page.alias("html")), "entry_no", "html")
    w = F.row_number().over(Window.partitionBy("entry_no").orderBy("n"))
    return rows.select("entry_no", F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), w).alias("n"), "heading", "line")


@query(f"""
SELECT entry_no, CASE WHEN t <> '' THEN t END AS title, CASE WHEN a <> '' THEN a END AS author, 'http://h' || entry_no || '.example/' AS homepage, CASE WHEN k <> '' THEN k END AS board FROM {_E}
""")
def tvf10_entry_fields(spark: SparkSession, d: str) -> DataFrame:
    """Title, author, homepage and board scraped out of an entry."""
    no = F.col("entry_no").cast("string")
    cell = _cat('<a href="n.html"><b>', F.col("t"), "</b></a> <B>", F.col("a"), ' さん</B> (<a href="http://h', no, '.example/">Homepage</a>) <a href="kansou/', F.col("k"), '/">感想</a>')
    who = listings.author_cell(F.regexp_replace(cell, "(?s)^.*?</a>", ""))
    return _episodes(spark, d).select("entry_no", listings.shown(F.regexp_extract(cell, "(?is)^(<a.*?</a>)", 1)).alias("title"), who["author"].alias("author"), who["homepage"].alias("homepage"), text.null_if_empty(F.regexp_extract(cell, r"kansou/([\w\-]+)", 1)).alias("board"))


@query("""
WITH h AS (SELECT DISTINCT homepage FROM authors WHERE homepage IS NOT NULL)
SELECT homepage AS url, lower(regexp_extract(homepage, '^[a-z]+://([^/]+)', 1)) AS host FROM h WHERE NOT regexp_matches(lower(homepage), '^[a-z]+://(members\\.example|[^/]*archive)')
""")
def tvf11_homepages(spark: SparkSession, d: str) -> DataFrame:
    """Homepages found in pages, without own and archive hosts."""
    page = F.concat(F.lit('<p><a href="'), F.col("homepage"), F.lit('">home</a><a href="x.html">x</a>'))
    found = table(spark, d, "authors").where("homepage is not null").select(F.explode(markup.links(page)).alias("url")).where("url rlike '^[a-z]+://'").distinct()
    return found.where(~F.lower("url").rlike(r"^[a-z]+://(members\.example|[^/]*archive)")).select("url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))


@query("""
WITH e AS (SELECT DISTINCT source_path AS path, epoch(date_trunc('second', min(loaded_at) OVER (PARTITION BY source_path)))::BIGINT AS epoch FROM episodes WHERE source_path IS NOT NULL AND NOT starts_with(source_path, '__C__') AND trim(source_path) <> '')
SELECT path, 'c' || epoch AS commit, epoch FROM e WHERE epoch IS NOT NULL
""")
def tvf12_first_commits(spark: SparkSession, d: str) -> DataFrame:
    """First commit of each path, out of the lines of a log that is written from the tables and read in order."""
    e = table(spark, d, "episodes").where("source_path is not null and loaded_at is not null and not startswith(source_path, '__C__') and trim(source_path) <> ''")
    e = e.select(F.unix_timestamp(F.date_trunc("second", F.col("loaded_at").cast("timestamp"))).alias("epoch"), "source_path").distinct()
    lines = e.select("epoch", F.array(F.concat(F.lit("__C__c"), "epoch", F.lit("|"), "epoch", F.lit("|subject | with a bar")), F.lit(""), "source_path").alias("_l")).select("epoch", F.posexplode("_l").alias("_p", "value"))
    # a commit's own lines follow its header, so each chunk of a log is read by itself
    log = parsers.commit_log(lines.withColumn("_at", F.concat_ws("-", F.lpad(F.col("epoch").cast("string"), 12, "0"), F.col("_p"))), "value", "_at", chunk="epoch")
    return parsers.first_commits(log).select("path", "commit", "epoch")


@query(f"""
SELECT entry_no, i AS image, CASE i WHEN 'cg/' || k || '1.gif' THEN 1 ELSE 2 END AS variant, k AS artist FROM (SELECT entry_no, k, unnest(['cg/' || k || '1.gif', 'cg/' || k || '2.gif']) AS i FROM {_E})
""")
def tvf15_gallery(spark: SparkSession, d: str) -> DataFrame:
    """Images of art pages with their number and artist."""
    page = _cat("<h1>", F.col("k"), '</h1><img src="cg/', F.col("k"), '1.gif"><img src="cg/', F.col("k"), '2.gif"><a href="x.html">x</a>')
    e = _episodes(spark, d).select("entry_no", F.explode(F.filter(markup.links(page), lambda x: x.rlike(r"(?i)\.(gif|jpe?g|png)$"))).alias("image"), F.regexp_extract(page, "(?is)<h1>(.*?)</h1>", 1).alias("artist"))
    return e.select("entry_no", "image", F.regexp_extract("image", r"(\d)\.[a-z]+$", 1).cast("int").alias("variant"), "artist")


@query(f"""
WITH w AS (SELECT DISTINCT entry_no, t FROM {_E} WHERE withdrawn_at IS NOT NULL) SELECT 'novel/' || t || entry_no || '.html' AS path, true AS whole FROM w UNION SELECT 'art/' || entry_no || '/', false FROM w
""")
def tvf14_deny_lines(spark: SparkSession, d: str) -> DataFrame:
    """Paths that the lines of a server's rules deny, whole or by their beginning."""
    no = F.col("entry_no").cast("string")
    e = _episodes(spark, d).where("withdrawn_at is not null")
    lines = F.array(_cat("# Redirect gone /x", no), _cat("Redirect gone /novel/", F.col("t"), no, ".html"), _cat("RewriteRule ^art/", no, "/ - [G,L]"), _cat("RewriteRule ^y", no, "$ /z [R=301]"), F.lit(""), _cat("RewriteRule ^novel/", F.col("t"), no, "\\.html$ - [G]"))
    return parsers.denied_paths(e.select(F.explode(lines).alias("value")), "value")


_RULES = {"shebang": r"^#!", "perl": r"(?:^|\s)my \$\w+\s*=", "password": r"(?i)password\s*=\s*[^\s<>&]{4,}", "hidden-field": r"(?i)<input[^>]*type=.?hidden[^>]*name=.?pass"}


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line_no FROM (
  SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT -entry_no, '#!/usr/bin/perl' || chr(10) || 'my $x = 1;' || chr(10) || 'password=' || {_s('title')} FROM episodes)),
r AS (SELECT doc_id, line_no, unnest([CASE WHEN regexp_matches(line, '^#!') THEN 'shebang' END, CASE WHEN regexp_matches(line, '(?:^|\\s)my \\$\\w+\\s*=') THEN 'perl' END,
  CASE WHEN regexp_matches(line, '(?i)password\\s*=\\s*[^\\s<>&]{{4,}}') THEN 'password' END, CASE WHEN regexp_matches(line, '(?i)<input[^>]*type=.?hidden[^>]*name=.?pass') THEN 'hidden-field' END]) AS rule FROM l)
SELECT doc_id, line_no, rule FROM r WHERE rule IS NOT NULL
""")
def tvf16_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like code or secrets, by rule, never with the value."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    made = table(spark, d, "episodes").select((-F.col("entry_no")).alias("doc_id"), _cat("#!/usr/bin/perl\nmy $x = 1;\npassword=", solid("title")).alias("text"))
    return parsers.secret_lines(docs.unionByName(made), "doc_id", "text", _RULES)


# ---- conversion of bodies


@query(f"""
SELECT entry_no, '<p>' || t || 'です。</p><hr>' AS region, '<a href="i.html">戻る</a><hr>' || k || '<hr>' AS head, '<a href="i.html">目次</a>' AS tail FROM {_E}
""")
def txt03_chrome(spark: SparkSession, d: str) -> DataFrame:
    """Bodies without the navigation before and behind them."""
    b = bodies.stripped(_cat('<a href="i.html">戻る</a><hr>', F.col("k"), "<hr><p>", F.col("t"), 'です。</p><hr><a href="i.html">目次</a>'))
    return _episodes(spark, d).select("entry_no", b["region"].alias("region"), b["head"].alias("head"), b["tail"].alias("tail"))


@query(f"SELECT entry_no, t || '。' || chr(10) || '戻る' || chr(10) || a || 'だ' || chr(10) AS text, '<< 戻る' AS head, '次へ|TOP' AS tail FROM {_E}")
def txt04_nav_lines(spark: SparkSession, d: str) -> DataFrame:
    """Navigation lines taken off at the ends, not inside."""
    b = bodies.trimmed(_cat("\n<< 戻る\n----\n", F.col("t"), "。\n戻る\n", F.col("a"), "だ\n\n次へ\nTOP\n"))
    return _episodes(spark, d).select("entry_no", b["text"].alias("text"), F.array_join(b["head"], "|").alias("head"), F.array_join(b["tail"], "|").alias("tail"))


@query(f"SELECT entry_no, CASE WHEN (5 * length(t) + length(a)) / 6.0 < 20 THEN 'data' ELSE 'layout' END AS kind, 'layout' AS single FROM {_E}")
def txt05_table_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tables of data told from tables of layout."""
    t = F.concat(F.lit("<table>"), F.repeat(_cat("<td>", F.col("t"), "</td>"), F.lit(5)), F.lit("<th>"), F.col("a"), F.lit("</th></table>"))
    return _episodes(spark, d).select("entry_no", bodies.table_kind(t).alias("kind"), bodies.table_kind(_cat("<table><td>", F.col("t"), "</td></table>")).alias("single"))


_ENDS = bodies.SENTENCE_ENDS
_JOIN = f"regexp_replace({{}}, '([^{_ENDS}\\n])\\n([^\\n「『　])', '\\1\\2', 'g')"


@query(f"SELECT doc_id, {_JOIN.format(_JOIN.format('text'))} AS text FROM documents WHERE text IS NOT NULL")
def txt06_reflow(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their hard wraps joined."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", bodies.reflowed(F.col("text")).alias("text"))


@query(f"""
SELECT entry_no, CASE WHEN t <> '' THEN t || '<ruby>漢<rt>かん</rt></ruby>' ELSE '<ruby>漢<rt>かん</rt></ruby>' END || chr(10) || chr(10) || '----' || chr(10) || chr(10) || '> 引' || a || chr(10) || '> 二' || chr(10) || chr(10) || '## 見' || k || chr(10) || chr(10)
  || '<img src="a.gif"> &lt;x&gt;' || chr(10) AS md, 'br-para' AS mode FROM {_E}
""")
def txt07_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as Markdown, ruby and images kept."""
    b = bodies.to_markdown(_cat("<p>", F.col("t"), "<ruby>漢<rt>かん</rt></ruby></p><hr><blockquote>引", F.col("a"), "\n二</blockquote><h2>見", F.col("k"), '</h2><img src="a.gif"> &lt;x&gt;'))
    return _episodes(spark, d).select("entry_no", b["md"].alias("md"), b["mode"].alias("mode"))


@query(f"SELECT entry_no, '<a name=p2>' || a AS part, true AS found, false AS other FROM {_E}")
def txt08_anchor_parts(spark: SparkSession, d: str) -> DataFrame:
    """The part of a page at an anchor, whatever its case."""
    page = _cat('<a name="p1">', F.col("t"), "</a><a name=p2>", F.col("a"))
    b = bodies.part_at(page, F.lit("#P2"))
    return _episodes(spark, d).select("entry_no", b["part"].alias("part"), b["found"].alias("found"), bodies.part_at(page, F.lit("zz"))["found"].alias("other"))


@query("""
SELECT e.entry_no, CASE WHEN d.e IS NOT NULL THEN 'md' WHEN regexp_matches(source_path, '^(?:[a-z]+://|external/)') THEN 'stub' WHEN source_path IS NULL OR source_path = '' OR size_kb IS NULL THEN 'no-source' ELSE 'md' END AS status,
  CASE WHEN d.e IS NOT NULL THEN 'plain-text' WHEN regexp_matches(source_path, '^(?:[a-z]+://|external/)') THEN 'external-link' WHEN source_path IS NULL OR source_path = '' OR size_kb IS NULL THEN NULL
    WHEN regexp_matches(source_path, '(?i)\\.(?:gif|jpe?g|png)$') THEN 'image-work' WHEN regexp_matches(source_path, '(?i)\\.txt$') THEN 'plain-text' ELSE 'br-para' END AS mode
FROM episodes e LEFT JOIN (SELECT DISTINCT episode_id AS e FROM documents WHERE kind = 'body') d ON e.episode_id = d.e
""")
def txt10_routes(spark: SparkSession, d: str) -> DataFrame:
    """How the body of every line comes about."""
    held = table(spark, d, "documents").where("kind = 'body'").select("episode_id", F.col("episode_id").alias("_e")).distinct()
    e = table(spark, d, "episodes").join(held, "episode_id", "left")
    r = bodies.route(F.col("source_path"), F.col("size_kb").isNotNull(), F.col("_e"))
    return e.select("entry_no", r["status"].alias("status"), r["mode"].alias("mode"))


_PARTS = "CASE entry_no % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'match-but-chrome-suspect' WHEN 3 THEN 'no-md' ELSE 'match-anchor' END"


def _rechecked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("entry_no") % 5
    lead = F.when(k.isin(2, 4), "<p>前置きの文。</p>").otherwise('<a href="i">戻る</a>')
    page = _cat("<html><title>T</title><script>var a = '<p>';</script><body>", lead, "<p>", F.col("t"), "が&amp;いる。</p></body></html>")
    md = F.when(k != 3, _cat(F.when(k == 1, "違う").otherwise(""), F.col("t"), "が&いる。\n"))
    e = _episodes(spark, d).select("entry_no", "k", page.alias("page"), md.alias("md"), (k == 4).alias("anchored"))
    return e.select("entry_no", bodies.rechecked(F.col("page"), F.col("md"), F.col("anchored")).alias("r")).select("entry_no", "r.*")


@query(f"SELECT entry_no, {_PARTS} AS result, CASE WHEN entry_no % 5 IN (2, 4) THEN 6 WHEN entry_no % 5 = 0 THEN 2 END AS dropped_head, CASE WHEN entry_no % 5 IN (0, 2, 4) THEN 0 END AS dropped_tail FROM episodes")
def txt11_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Conversions checked again by another parser."""
    return _rechecked(spark, d)


@query(f"""
WITH r AS (SELECT {_PARTS} AS result, CASE WHEN entry_no % 5 IN (2, 4) THEN 6 WHEN entry_no % 5 = 0 THEN 2 END AS h FROM episodes)
SELECT result, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, max(h) AS dropped_head_max FROM r GROUP BY result
""")
def agg15_recheck_summary(spark: SparkSession, d: str) -> DataFrame:
    """How the re-checks came out."""
    g = _rechecked(spark, d).groupBy("result").agg(F.count("*").alias("n"), F.max("dropped_head").alias("dropped_head_max"))
    total = g.agg(F.sum("n").alias("_t"))
    return g.join(F.broadcast(total)).select("result", "n", F.round(100.0 * F.col("n") / F.col("_t"), 2).alias("pct"), "dropped_head_max")


_VERDICTS = "CASE entry_no % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok-trimmed' WHEN 2 THEN 'ng-extra' WHEN 3 THEN 'ng-missing' WHEN 4 THEN 'ng-order' ELSE 'ok-texturize' END"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("entry_no") % 6
    t = F.col("t")
    original = F.when(k == 1, _cat("あ" * 20, t, "ABCDEFGHIJKLMNOP")).when(k == 5, _cat(t, "です…AB")).otherwise(_cat(t, "ABCDEFGHIJKLMNOP"))
    shown = (
        F.when(k == 2, _cat(t, "ABCDEFGHXXXXXXXXXXXXXXXXXXXXIJKLMNOP")).when(k == 3, _cat(t, "ABNOP")).when(k == 4, _cat("PONMLKJIHGFEDCBA", t))
        .when(k == 5, _cat(t, "です...AB")).otherwise(_cat(t, "ABCDEFGHIJKLMNOP"))
    )
    return _episodes(spark, d).select("entry_no", bodies.verdict(original, shown).alias("verdict"))


@query(f"SELECT entry_no, {_VERDICTS} AS verdict FROM episodes")
def txt12_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of shown pages against their originals."""
    return _verdicts(spark, d)


@query(f"SELECT count(*) AS n, round(100.0 * count(*) FILTER (starts_with(v, 'ng-')) / count(*), 2) AS problem_pct, count(*) FILTER (v = 'ok') AS ok FROM (SELECT {_VERDICTS} AS v FROM episodes)")
def agg16_problem_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rate of bad verdicts."""
    bad = F.count_if(F.col("verdict").startswith("ng-") | (F.col("verdict") == "error"))
    return _verdicts(spark, d).agg(F.count("*").alias("n"), F.round(100.0 * bad / F.count("*"), 2).alias("problem_pct"), F.count_if(F.col("verdict") == "ok").alias("ok"))


@query(f"""
SELECT entry_no, n, kind, text FROM (SELECT entry_no, unnest([1, 2, 3, 4, 5]) AS n, unnest(['heading', 'paragraph', 'rule', 'quote', 'image']) AS kind,
  unnest(['h' || t, 'p' || a || chr(10) || 'q', '', 'x' || k || chr(10) || 'y', '![' || t || '](p.gif)']) AS text FROM {_E})
""")
def txt13_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Markdown in blocks."""
    md = _cat("## h", F.col("t"), "\n\np", F.col("a"), "\nq\n\n----\n\n> x", F.col("k"), "\n> y\n\n![", F.col("t"), "](p.gif)\n")
    rows = _episodes(spark, d).select("entry_no", F.posexplode(bodies.blocks(md)).alias("_n", "b"))
    return rows.select("entry_no", (F.col("_n") + 1).alias("n"), "b.kind", "b.text")


_KEY = "lower(regexp_replace(translate(title, '{w}', '{t}'), '[\\s　!?！？。、・~〜「」『』()\\-]+', '', 'g'))".format(w=text.WIDE.replace("'", "''"), t=text.THIN.replace("'", "''"))


@query(f"""
WITH k AS (SELECT entry_no, author, {_KEY} AS key FROM episodes WHERE title IS NOT NULL AND author IS NOT NULL)
SELECT entry_no, min(entry_no) OVER w AS version_of, count(*) OVER w AS versions FROM k WHERE key <> '' WINDOW w AS (PARTITION BY author, key)
""")
def txt16_version_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one author and one title, however it is written."""
    e = table(spark, d, "episodes").where("title is not null and author is not null").select("entry_no", "author", text.title_key(F.col("title")).alias("key")).where("key <> ''")
    g = e.groupBy("author", "key").agg(F.min("entry_no").alias("version_of"), F.count("*").alias("versions"))
    return e.join(g, ["author", "key"]).select("entry_no", "version_of", "versions")


@query()
def txt17_line_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Lines changed, added and removed between the documents of an episode and kind and the first of them."""
    t = table(spark, d, "documents").where("text is not null and episode_id is not null").select("doc_id", "kind", "episode_id", "text")
    heads = t.groupBy("kind", "episode_id").agg(F.min(F.struct("doc_id", "text")).alias("h"))
    pairs = t.join(heads, ["kind", "episode_id"]).where("doc_id <> h.doc_id")
    return pairs.select("doc_id", F.col("h.doc_id").alias("first"), bodies.line_diff(F.col("h.text"), F.col("text")).alias("c")).select("doc_id", "first", "c.*")


@query()
def agg26_least_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The least similarity of any version to the canonical one of its group."""
    t = table(spark, d, "documents").where("text is not null and episode_id is not null").select("doc_id", "kind", "episode_id", "text")
    v = versions.compared_versions(t, ["kind", "episode_id"], [F.col("doc_id")], "doc_id", "text")
    return v.groupBy("canonical").agg(F.min("sim").alias("least"), F.count("*").alias("versions"))
