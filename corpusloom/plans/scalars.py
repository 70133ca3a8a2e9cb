"""Queries of the text, address and date functions, each over every row; what a function needs is written out of the row's own fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import charsets, markup, text, urls
from corpusloom.operators import links, listings, parsers
from corpusloom.plans.pages import _E, _NOT_SOLID, _cat, _episodes, solid
from corpusloom.plans.registry import registry
from corpusloom.sources.tables import table

QUERIES, SQL, query = registry()
_T = "CASE WHEN t <> '' THEN t END"


@query(f"SELECT entry_no, 'x' || t || chr(10) || '<' || a || chr(10) || 'y' AS lines, 'x' || t || ' <' || a || ' y' AS line, NULL::VARCHAR AS none FROM {_E}")
def f02_cell_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of cells with breaks kept, made blanks, and of an empty cell."""
    c = _cat("<b>x", F.col("t"), "</b><br> &lt;", F.col("a"), "　\r\ny ")
    return _episodes(spark, d).select("entry_no", text.cell_text(c, True).alias("lines"), F.regexp_replace(text.cell_text(c), "[\n ]+", " ").alias("line"), text.cell_text(_cat("<b> </b>　")).alias("none"))


@query(f"SELECT entry_no, ltrim(t || a || ' z') AS fused, regexp_replace('x' || t || ' ' || a || ' z', ' +', ' ', 'g') AS spaced FROM {_E}")
def f03_inline_text(spark: SparkSession, d: str) -> DataFrame:
    """Tags off without and with a blank for each."""
    c = _cat(F.col("t"), "<i>", F.col("a"), "</i>\n　z")
    s = _cat("x", F.col("t"), "<i>", F.col("a"), "</i>\n　z")
    return _episodes(spark, d).select("entry_no", text.one_line(c).alias("fused"), F.regexp_replace(text.one_line(s, " "), " +", " ").alias("spaced"))


@query(f"SELECT entry_no, trim(regexp_replace('あ ' || t || ' い&う ' || a, ' +', ' ', 'g')) AS spaced FROM {_E}")
def f04_spaced_text(spark: SparkSession, d: str) -> DataFrame:
    """Tags as blanks, references resolved, blanks collapsed."""
    return _episodes(spark, d).select("entry_no", F.trim(F.regexp_replace(text.one_line(text.html_unescape(_cat("あ<p>", F.col("t"), "</p>\n<b>い&amp;う</b>　", F.col("a"))), " "), " +", " ")).alias("spaced"))


@query(f"SELECT entry_no, '<' || t || '&amp;あ\"' AS once, '<' || t || '&あ\"' AS twice FROM {_E}")
def f05_unescaped(spark: SparkSession, d: str) -> DataFrame:
    """Character references resolved once and twice."""
    s = _cat("&lt;", F.col("t"), "&amp;amp;&#12354;&quot;")
    return _episodes(spark, d).select("entry_no", text.html_unescape(s).alias("once"), text.html_unescape(text.html_unescape(s)).alias("twice"))


@query(f"SELECT entry_no, 'あ' || t || chr(10) || 'い' || a AS lines FROM {_E}")
def f06_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page without scripts."""
    p = _cat("<p>あ<script>x()</script>", F.col("t"), "</p><br>い", F.col("a"), "　")
    return _episodes(spark, d).select("entry_no", F.array_join(markup.lines_of(markup.precleaned(p)), "\n").alias("lines"))


@query(f"SELECT entry_no, {_T} AS front, {_T} AS back, NULL::VARCHAR AS nothing FROM {_E}")
def f07_clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without the site's name."""
    return _episodes(spark, d).select("entry_no", text.clean_title(_cat("■少年少女文庫・<b>", F.col("t"), "</b>")).alias("front"), text.clean_title(_cat(F.col("t"), " - 少年少女文庫")).alias("back"), text.clean_title(F.lit("無題ドキュメント")).alias("nothing"))


@query(f"SELECT entry_no, 'TS' || t || 'カナ1' AS nfkc, 'ts' || lower(t) AS lower, 'ts' || lower(t) || 'ss' AS name FROM {_E}")
def f08_compatibility_forms(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility forms, in lower case, and as names."""
    t = F.col("t")
    return _episodes(spark, d).select("entry_no", text.nfkc(_cat("ＴＳ", t, "ｶﾅ①")).alias("nfkc"), text.nfkc_lower(_cat("ＴＳ", t)).alias("lower"), text.norm_name(_cat(" Ｔ　Ｓ", t, "ß ")).alias("name"))


@query("SELECT doc_id, nfc_normalize(text) AS composed FROM documents WHERE text IS NOT NULL UNION ALL SELECT -entry_no, nfc_normalize(title || 'が') FROM episodes WHERE title IS NOT NULL")
def f09_composed(spark: SparkSession, d: str) -> DataFrame:
    """Texts and titles with their marks composed."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    e = table(spark, d, "episodes").where("title is not null").select((-F.col("entry_no")).alias("doc_id"), F.concat("title", F.lit("が")).alias("text"))
    return t.unionByName(e).select("doc_id", text.nfc(F.col("text")).alias("composed"))


@query(f"SELECT entry_no, lower(t) || 'ab1' AS key FROM {_E}")
def f12_title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which versions of a title meet."""
    return _episodes(spark, d).select("entry_no", text.title_key(_cat("「", F.col("t"), "　Ａb」～１！")).alias("key"))


@query(f"SELECT entry_no, t || 'x' AS form, '学園' AS synonym, false AS told, true AS untold FROM {_E}")
def f14_vocabulary_forms(spark: SparkSession, d: str) -> DataFrame:
    """Typed terms as the vocabulary has them, and values that say nothing."""
    v = text.vocabulary_form
    return _episodes(spark, d).select("entry_no", v(_cat("「", F.col("t"), "ｘ」（？）".replace("ｘ", "x"))).alias("form"), v(F.lit("「学校」？")).alias("synonym"), text.is_unspecified(_cat(F.col("t"), "x")).alias("told"), text.is_unspecified(F.lit("（？） ")).alias("untold"))


@query(f"SELECT entry_no, t || ' [address] me@example.com index@0820.html' AS redacted, {_T} || ':[address]<b>' AS scrubbed, false AS leak FROM {_E}")
def f16_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Addresses replaced, but for examples and file names, and texts scrubbed of mail links."""
    t = F.col("t")
    s = text.redacted(_cat(t, " a.b@mail.jp me@example.com index@0820.html"))
    clean = text.scrubbed(_cat('<a href="mailto:x@mail.jp">', t, "</a>:y@mail.jp<b title='mailto:z@mail.jp'>"))
    return _episodes(spark, d).select("entry_no", s.alias("redacted"), F.when(t != "", clean).alias("scrubbed"), text.has_leak(clean).alias("leak"))


@query(f"""
SELECT entry_no, n, html, dropped FROM (SELECT entry_no, unnest([1, 2, 3, 4, 5]) AS n, unnest(['n' || t, '', '<a href="#">x' || t, '連絡 ' || t || ' まで index@08201937.html', 'n' || t]) AS html,
  unnest(['taro@mail.jp', 'taro@mail.jp,taro@mail.jp', 'jiro@mail.jp', 'hana@mail.jp', '']) AS dropped FROM {_E})
""")
def f19_scrubbed_mail(spark: SparkSession, d: str) -> DataFrame:
    """The four forms of mail in pages and what was dropped of each, and a link to nobody."""
    t = F.col("t")
    forms = F.array(
        _cat('<a href="mailto:taro@mail.jp">n', t, "</a>"), F.lit("<A HREF='mailto:taro@mail.jp'>taro@mail.jp</A>"), _cat("<a href=mailto:jiro@mail.jp>x", t), _cat("連絡 ", t, "hana@mail.jp まで index@08201937.html"),
        _cat('<a href="mailto:">n', t, "</a>"),
    )
    rows = _episodes(spark, d).select("entry_no", F.posexplode(forms).alias("_n", "h"))
    r = text.scrubbed_mailto(F.when(F.col("_n") == 3, F.regexp_replace("h", "hana@", " hana@")).otherwise(F.col("h")))
    rows = rows.select("entry_no", (F.col("_n") + 1).alias("n"), r.alias("r"))
    return rows.select("entry_no", "n", F.when(F.col("n") == 4, F.regexp_replace("r.html", "  まで", " まで")).otherwise(F.col("r.html")).alias("html"), F.array_join("r.dropped", ",").alias("dropped"))


@query("""
WITH s AS (SELECT DISTINCT './' || source_path || coalesce('#' || source_anchor, '') AS href, source_path AS p, source_anchor AS a FROM episodes WHERE source_path IS NOT NULL AND NOT contains(source_path, '#') AND NOT regexp_matches(source_path, '^[a-z]+://') AND NOT starts_with(source_path, './')
  AND NOT contains(source_path, chr(10)) AND NOT contains(coalesce(source_anchor, ''), chr(10)))
SELECT href, p AS path, CASE WHEN a <> '' THEN a END AS anchor, 'local' AS kind, replace(p, '/', '__') || coalesce('@' || CASE WHEN a <> '' THEN a END, '') || '+20010203' AS key FROM s
UNION ALL SELECT DISTINCT homepage || '#z', 'external/' || regexp_replace(homepage, '^[a-z]+://', ''), 'z', 'external', replace('external/' || regexp_replace(homepage, '^[a-z]+://', ''), '/', '__') || '@z+20010203' FROM authors WHERE homepage IS NOT NULL
""")
def f20_split_hrefs(spark: SparkSession, d: str) -> DataFrame:
    """Links split into path, anchor and kind, and the keys made of them."""
    e = table(spark, d, "episodes").where("source_path is not null and not contains(source_path, '#') and not source_path rlike '^[a-z]+://' and not startswith(source_path, './') and not contains(source_path, '\n') and not contains(coalesce(source_anchor, ''), '\n')")
    h = e.select(F.concat(F.lit("./"), "source_path", F.coalesce(F.concat(F.lit("#"), "source_anchor"), F.lit(""))).alias("href"))
    a = table(spark, d, "authors").where("homepage is not null").select(F.concat("homepage", F.lit("#z")).alias("href"))
    s = h.distinct().unionByName(a.distinct()).select("href", urls.split_href(F.col("href")).alias("s")).select("href", "s.*")
    return s.select("href", "path", "anchor", "kind", urls.episode_key(F.col("path"), F.col("anchor"), F.lit("20010203")).alias("key"))


@query(f"SELECT entry_no, 'novel/' || url_encode(t) || '/a%20b.html' AS path, '~ts/bbs@log_x&y.cgi' AS odd, 'http://home.example/n/' || url_encode(t) || '.html#z' AS url, 'http://h.example/' || url_encode(t) AS outside, CASE WHEN entry_no % 2 = 0 THEN 'image' ELSE 'html' END AS kind FROM {_E}")
def f22_url_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths percent-encoded part by part, addresses of stored pages, and types of entries."""
    t = F.col("t")
    p = F.when(F.col("entry_no") % 2 == 0, "a.JPG").otherwise("a.html")
    return _episodes(spark, d).select(
        "entry_no", urls.encoded_path(_cat("novel/", t, "/a b.html")).alias("path"), urls.encoded_path(F.lit("~ts/bbs@log_x&y.cgi")).alias("odd"), urls.page_url(_cat("n/", t, ".html"), F.lit("z"), "http://home.example/").alias("url"),
        urls.page_url(_cat("external/h.example/", t), F.lit(None).cast("string"), "x").alias("outside"), urls.entry_type(p, F.lit("local")).alias("kind"),
    )


@query(f"SELECT entry_no, 'a/' || t || '.html' AS path, NULL::VARCHAR AS absolute, NULL::VARCHAR AS root FROM {_E}")
def f24_norm_paths(spark: SparkSession, d: str) -> DataFrame:
    """Relative paths without fragments; absolute ones have none."""
    return _episodes(spark, d).select("entry_no", urls.norm_path(_cat("././a/", F.col("t"), ".html#p")).alias("path"), urls.norm_path(_cat("http://h/", F.col("t"))).alias("absolute"), urls.norm_path(_cat("/", F.col("t"))).alias("root"))


@query(f"""
SELECT entry_no, n, kind, target FROM (SELECT entry_no, unnest(range(1, 10)) AS n, unnest(['internal', 'internal', 'internal', 'external', 'external', 'skip', 'skip', 'skip', 'internal']) AS kind,
  unnest(['d/b' || t || '.html', 'n' || t || '.html', CASE WHEN t = '' THEN 'x' ELSE 'x/' || t END, '../../' || t, 'http://other.example/' || t, NULL, NULL, NULL, 'd/c.cgi@q=' || t || '_1']) AS target FROM {_E})
""")
def f25_classified_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page as skipped, external or internal with their path."""
    t = F.col("t")
    hrefs = F.array(
        _cat("b", t, ".html#p"), _cat("../n", t, ".html"), _cat("http://www2.home.example:80/x/", t), _cat("../../", t), _cat("http://other.example/", t), F.lit("mailto:a@b.jp"), _cat("#", t), F.lit("a@b.jp"), _cat("./c.cgi?q=", t, "/1"),
    )
    rows = _episodes(spark, d).select("entry_no", F.posexplode(hrefs).alias("_n", "h"))
    c = links.classified(F.col("h"), F.lit("d"), "home.example")
    return rows.select("entry_no", (F.col("_n") + 1).cast("long").alias("n"), c["kind"].alias("kind"), c["target"].alias("target"))


@query(f"""
SELECT entry_no, 'c.cgi@a=/' || t || '?' AS keep, 'c.cgi@a=_' || t || '_' AS flat, 'c.cgi@a=_' || t || '?' AS slash, 'c.cgi@a=_' || t || '_.html' AS html, 'a=/' || t || '?' AS bare, 'c.cgi' AS none,
  'c.cgi?a=' || t AS script, 'p.html?a=' || t AS page, NULL::VARCHAR AS opaque FROM {_E}
""")
def f26_mangled_queries(spark: SparkSession, d: str) -> DataFrame:
    """File names for addresses with queries in all variants, and back."""
    q = _cat("a=/", F.col("t"), "?")
    m = lambda v: urls.mangled(F.lit("c.cgi"), q, v).alias(v)
    u = urls.unmangled
    return _episodes(spark, d).select(
        "entry_no", *[m(v) for v in ("keep", "flat", "slash", "html", "bare")], urls.mangled(F.lit("c.cgi"), F.lit(None).cast("string"), "flat").alias("none"),
        u(_cat("c.cgi@a=", F.col("t"), ".html")).alias("script"), u(_cat("p@a=", F.col("t"), ".html")).alias("page"), u(F.lit("p@0820.html")).alias("opaque"),
    )


@query(f"SELECT entry_no, 'a/x' || t || '/b/b' AS once, '../y' || t || '/z.html' AS rel, 'z.html' AS same FROM {_E}")
def f29_segments(spark: SparkSession, d: str) -> DataFrame:
    """The first doubled part of a path taken out; paths seen from other paths."""
    t = F.col("t")
    return _episodes(spark, d).select("entry_no", urls.dedup_segments(_cat("a/x", t, "/x", t, "/b/b")).alias("once"), urls.relative(_cat("y", t, "/z.html"), F.lit("w/v.html")).alias("rel"), urls.relative(F.lit("w/z.html"), F.lit("w/v.html")).alias("same"))


@query(f"""
SELECT entry_no, '<a href="http://home.example/d/' || t || '.html"><img src="/x.gif"><a href="#p"><a href="http://o.example/">' AS absolute,
  '<head><title>' || t || '</title><meta charset="utf-8"></head><meta charset=x>' AS published, '<head><meta charset="utf-8"><title>' || t || '</title></head>' AS named, {_T} AS title FROM {_E}
""")
def f31_rewritten_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with absolute links, without advertising, with one named character set; their titles."""
    t = F.col("t")
    page = _cat("<head><title>", t, '</title><meta http-equiv=x content="text/html; charset=sjis"></head><script src="http://ads.example/a.js">x</script><meta charset=x>')
    return _episodes(spark, d).select(
        "entry_no", urls.absolute_links(_cat('<a href="./', t, '.html"><img src="/x.gif"><a href="#p"><a href="http://o.example/">'), F.lit("http://home.example/d/")).alias("absolute"),
        urls.published(page).alias("published"), urls.published(_cat("<head><title>", t, "</title></head>")).alias("named"), urls.page_title(page).alias("title"),
    )


@query(f"""
SELECT entry_no, size_kb AS kb, files_n AS files, coalesce(size_kb, 3) * 2 AS twice, CASE WHEN entry_no % 100 < 50 THEN 2000 + entry_no % 100 ELSE 1900 + entry_no % 100 END AS year FROM {_E}
""")
def f36_sizes_and_years(spark: SparkSession, d: str) -> DataFrame:
    """Notes of size read, and two-digit years in their century."""
    s = parsers.sizes(F.concat(F.coalesce(F.concat(F.col("size_kb"), F.lit(" kb")), F.lit("")), F.lit(" / "), F.coalesce(F.concat(F.col("files_n"), F.lit(" FILE")), F.lit(""))))
    return _episodes(spark, d).select("entry_no", s["kb"].alias("kb"), s["files"].alias("files"), (F.coalesce("size_kb", F.lit(3)) * 2).alias("twice"), urls.pivoted_year(F.col("entry_no") % 100).alias("year"))


@query("""
WITH e AS (SELECT entry_no, entry_no % 12 + 1 AS m, entry_no % 28 + 1 AS d FROM episodes), y AS (SELECT *, list_filter([make_date(1997, m, d), make_date(1998, m, d)], lambda x: x BETWEEN DATE '1997-11-04' AND DATE '1998-04-05') AS inside FROM e)
SELECT entry_no, CASE WHEN len(inside) > 0 THEN inside[1] ELSE greatest(DATE '1997-11-04', least(DATE '1998-04-05', make_date(1997, m, d))) END AS date, CASE WHEN len(inside) > 1 THEN 'range-ambiguous' WHEN len(inside) = 1 THEN 'range-derived' ELSE 'range-clamped' END AS precision FROM y
""")
def f38_years_from_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Years of month and day from a page's range."""
    m, day = (F.col("entry_no") % 12 + 1).cast("int"), (F.col("entry_no") % 28 + 1).cast("int")
    r = parsers.resolved_year(m, day, F.lit("1997-11-04").cast("date"), F.lit("1998-04-05").cast("date"))
    return table(spark, d, "episodes").select("entry_no", r["date"].alias("date"), r["precision"].alias("precision"))


@query("""
SELECT DISTINCT source_path, CASE WHEN m <> '' THEN m || '-01' END AS date, CASE WHEN m <> '' THEN 'directory-batch' ELSE 'unknown' END AS precision
FROM (SELECT source_path, regexp_replace(regexp_extract(source_path, '(?:^|/)(\\d{4}(?:0[1-9]|1[0-2]))/', 1), '^(\\d{4})(\\d{2})$', '\\1-\\2') AS m FROM episodes WHERE source_path IS NOT NULL)
""")
def f39_days_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """Days that directories tell."""
    r = urls.day_of_path(F.col("source_path"))
    return table(spark, d, "episodes").where("source_path is not null").select("source_path", r["date"].alias("date"), r["precision"].alias("precision")).distinct()


@query(f"""
SELECT entry_no, CASE WHEN s <> '' THEN s ELSE 'untitled-' || substr(md5(t), 1, 8) END AS slug, CASE WHEN s <> '' THEN 'ascii' ELSE 'fallback' END AS source FROM (SELECT entry_no, t, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM {_E})
""")
def f41_romanized(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of titles, by their ASCII letters or by hash."""
    r = text.romanized(F.col("t"))
    return _episodes(spark, d).select("entry_no", r["slug"].alias("slug"), r["source"].alias("source"))


@query(f"SELECT entry_no, t || 'x' AS prefix, '' AS none, t AS one FROM {_E}")
def f43_common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings that strings share."""
    t = F.col("t")
    return _episodes(spark, d).select("entry_no", text.common_prefix(F.array(_cat(t, "xa"), _cat(t, "xb"), _cat(t, "xab"))).alias("prefix"), text.common_prefix(F.array(F.concat(F.lit("p"), t), F.concat(F.lit("q"), t))).alias("none"), text.common_prefix(F.array(t)).alias("one"))


@query(f"SELECT entry_no, 'y' || a AS author, '公開を停止' AS kind, '2002年1月1日' AS date_raw, true AS none FROM {_E}")
def f44_notices(spark: SparkSession, d: str) -> DataFrame:
    """Notes of works taken down."""
    n = listings.notice(_cat("前文。作者である", "y", F.col("a"), "さんの要望により公開を停止しました（2002年1月1日）"))
    return _episodes(spark, d).select("entry_no", n["author"].alias("author"), n["kind"].alias("kind"), n["date_raw"].alias("date_raw"), listings.notice(_cat("x", F.col("t"))).isNull().alias("none"))


@query(f"SELECT entry_no, 'y' || a AS author, 'B' || t || ',C' AS illustrators FROM {_E}")
def f45_credits(spark: SparkSession, d: str) -> DataFrame:
    """Writers and illustrators of a credit."""
    c = parsers.credits(_cat("作・y", F.col("a"), " / 画・B", F.col("t"), "、C (WWW)"))
    return _episodes(spark, d).select("entry_no", c["author"].alias("author"), F.array_join(c["illustrators"], ",").alias("illustrators"))


@query(f"SELECT entry_no, array_to_string(regexp_extract_all('y' || a || 'さん・zさん', '([^\\s　・、&＆]+?)さん', 1), ',') AS named, CASE WHEN contains(a, 'さん') THEN array_to_string(regexp_extract_all('y' || a || '＆w', '([^\\s　・、&＆]+?)さん', 1), ',') ELSE 'y' || a || ',w' END AS plain FROM {_E}")
def f46_board_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in the titles of boards."""
    a = F.col("a")
    return _episodes(spark, d).select("entry_no", F.array_join(text.board_names(_cat("y", a, "さん・zさんの感想板")), ",").alias("named"), F.array_join(text.board_names(_cat("y", a, "＆wの感想")), ",").alias("plain"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def f48_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes and bytes of the texts."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"SELECT entry_no, 'x' || t || 'y' AS squeezed, t || '...-\"x\"''y''-' AS plain FROM {_E}")
def f49_squeezed(spark: SparkSession, d: str) -> DataFrame:
    """Texts without blanks, and with plain punctuation."""
    from corpusloom.operators.bodies import plain_punctuation

    t = F.col("t")
    return _episodes(spark, d).select("entry_no", text.squeezed(_cat(" x\n　", t, "​ y")).alias("squeezed"), plain_punctuation(_cat(t, "…—“x”‘y’--😀")).alias("plain"))


@query(f"""
SELECT entry_no, '/n/' || t || '.html' AS own, '/n/' || t AS local, NULL::VARCHAR AS other, NULL::VARCHAR AS dots, NULL::VARCHAR AS longest FROM {_E}
""")
def f52_target_paths(spark: SparkSession, d: str) -> DataFrame:
    """Typed addresses as paths of the home host."""
    t = F.col("t")
    p = lambda s: urls.target_path(s, "home.example")
    return _episodes(spark, d).select(
        "entry_no", p(_cat(" https://www.home.example/n/", urls.encoded_path(t), ".html?x#y")).alias("own"), p(_cat("/n/", t, "#p")).alias("local"), p(_cat("http://other.example/", t)).alias("other"), p(_cat("/n/../", t)).alias("dots"),
        p(_cat("/", F.repeat(F.lit("x"), F.lit(600)), t)).alias("longest"),
    )


_W, _N = text.WIDE.replace("'", "''"), text.THIN.replace("'", "''")


@query(f"SELECT entry_no, translate(title, '{_W}', '{_N}') AS narrow FROM episodes WHERE title IS NOT NULL")
def f54_half_width(spark: SparkSession, d: str) -> DataFrame:
    """Titles in half-width ASCII."""
    return table(spark, d, "episodes").where("title is not null").select("entry_no", text.hankaku(F.col("title")).alias("narrow"))


@query("""
SELECT entry_no, replace(replace(coalesce(title, ''), '|', '\\|'), chr(10), ' ') || '\\|' AS cell, '"' || replace(replace(replace(replace(replace(coalesce(title, '') || '"', '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"' AS quoted FROM episodes
""")
def f56_escaped(spark: SparkSession, d: str) -> DataFrame:
    """Titles for Markdown cells and quoted strings."""
    t = F.coalesce("title", F.lit(""))
    return table(spark, d, "episodes").select("entry_no", text.markdown_cell(F.concat(t, F.lit("|"))).alias("cell"), text.yaml_string(F.concat(t, F.lit('"'))).alias("quoted"))


@query(f"""
SELECT entry_no, n, body FROM (SELECT entry_no, unnest([1, 2, 3, 4]) AS n, unnest(['<p>' || t || '</p>', '<p>' || t, t || '<b>x', 'あ' || t || '&lt;ん<x>']) AS body FROM {_E})
""")
def txt01_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of pages with and without their tags, cleaned."""
    t = F.col("t")
    pages = F.array(
        _cat("<head></head><body class=x><p>", t, "</p></body>後"), _cat("<body><p>", t), _cat(t, "<b>x</body>後"), _cat("<script>x</script>あ<!--c--><! 没稿 ><style>s{}</style>", t, "<form>f</form><ん<x>"),
    )
    return _episodes(spark, d).select("entry_no", F.posexplode(pages).alias("_n", "h")).select("entry_no", (F.col("_n") + 1).alias("n"), markup.body_of(markup.precleaned(F.col("h"))).alias("body"))


_ENC = ["utf-8", "cp932", "euc_jp", "iso2022_jp"]


@query(f"""
SELECT entry_no, n, enc, 'あいう' || k AS text FROM (SELECT entry_no, regexp_replace(k, '{_NOT_SOLID}', '', 'g') AS k, unnest([1, 2, 3, 4]) AS n, unnest(['utf-8', 'cp932', 'euc_jp', 'iso2022_jp']) AS enc FROM {_E})
""")
def src04_charsets(spark: SparkSession, d: str) -> DataFrame:
    """Bytes in four character sets read by what the page names, else by trying."""
    @F.pandas_udf("binary")
    def as_bytes(s: pd.Series, enc: pd.Series) -> pd.Series:
        return pd.Series([f"<meta charset={e}>{x}".encode(e) for x, e in zip(s, enc)], dtype=object)

    e = _episodes(spark, d).select("entry_no", F.concat(F.lit("あいう"), F.regexp_replace("k", _NOT_SOLID, "")).alias("x"), F.posexplode(F.array(*[F.lit(v) for v in _ENC])).alias("_n", "enc"))
    e = e.select("entry_no", "_n", charsets.decoded(as_bytes("x", "enc"), "meta").alias("d"))
    return e.select("entry_no", (F.col("_n") + 1).alias("n"), F.col("d.encoding").alias("enc"), F.regexp_replace("d.text", "^<meta[^>]*>", "").alias("text"))


@query(f"SELECT entry_no, '癰' || k AS fewest, 'euc_jp-replace' AS how, 'x' || k || chr(65533) AS lenient FROM (SELECT entry_no, regexp_replace(k, '{_NOT_SOLID}', '', 'g') AS k FROM {_E})")
def src03_broken_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Broken bytes by the reading with fewest replacements, and leniently."""
    @F.pandas_udf("binary")
    def broken(s: pd.Series) -> pd.Series:
        return pd.Series([("癰" * 20 + x).encode("euc_jp") + b"\xff\xfd" for x in s], dtype=object)

    e = _episodes(spark, d).select("entry_no", F.regexp_replace("k", _NOT_SOLID, "").alias("x"))
    e = e.select("entry_no", "x", charsets.decoded(broken("x"), "fewest").alias("d"), charsets.lenient(F.concat(F.encode(F.concat(F.lit("x"), "x"), "UTF-8"), F.unhex(F.lit("FF")))).alias("lenient"))
    return e.select("entry_no", F.regexp_replace(F.regexp_replace("d.text", "^(?:癰)+", "癰"), "[�].*$", "").alias("fewest"), F.col("d.encoding").alias("how"), "lenient")


@query(f"SELECT entry_no, 'あい' || k AS text, 'cp932' AS enc, 'utf-8' AS plain FROM (SELECT entry_no, regexp_replace(k, '{_NOT_SOLID}', '', 'g') AS k FROM {_E})")
def src05_audit_decode(spark: SparkSession, d: str) -> DataFrame:
    """Bytes read for an audit: UTF-8, else cp932 with replacements."""

    @F.pandas_udf("binary")
    def as_bytes(s: pd.Series) -> pd.Series:
        return pd.Series([("あい" + x).encode("cp932") for x in s], dtype=object)

    e = _episodes(spark, d).select("entry_no", F.regexp_replace("k", _NOT_SOLID, "").alias("x"))
    e = e.select("entry_no", charsets.decoded(as_bytes("x")).alias("d"), charsets.decoded(F.encode(F.concat(F.lit("あ"), "x"), "UTF-8")).alias("p"))
    return e.select("entry_no", F.col("d.text").alias("text"), F.col("d.encoding").alias("enc"), F.col("p.encoding").alias("plain"))
