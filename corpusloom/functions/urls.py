"""Paths and addresses as columns: parts of links, keys, reversed hosts, normalised and candidate paths."""

from __future__ import annotations

import posixpath
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_href(href: Column) -> Column:
    """struct<path, anchor, kind> of a link; other hosts' links become external/<host><path>; an empty anchor is null."""
    clean = F.regexp_replace(href, r"^\./", "")
    anchor = F.when(clean.contains("#"), F.regexp_extract(clean, "#(.*)$", 1))
    path = F.regexp_replace(clean, "#.*$", "")
    outside = path.rlike("^[a-z]+://")
    return F.struct(
        F.when(outside, F.concat(F.lit("external/"), F.regexp_replace(path, "^[a-z]+://", ""))).otherwise(path).alias("path"),
        F.when(anchor != "", anchor).alias("anchor"),
        F.when(outside, "external").otherwise("local").alias("kind"),
    )


def episode_key(path: Column, anchor: Column, day: Column) -> Column:
    """Key of a catalogue line: path with __ for /, @anchor and +day where present."""
    return F.concat(F.replace(path, F.lit("/"), F.lit("__")), F.coalesce(F.concat(F.lit("@"), anchor), F.lit("")), F.coalesce(F.concat(F.lit("+"), day), F.lit("")))


def first_segment(path: Column) -> Column:
    """The first part of a path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def basename(path: Column) -> Column:
    """The last part of a path."""
    return F.split_part(path, F.lit("/"), F.lit(-1))


def dirname(path: Column) -> Column:
    """The path up to its last slash, empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first."""
    parts = F.split(dirname(path), "/", -1)
    n = F.size(parts)
    return F.when(dirname(path) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def surt_host(host: Column) -> Column:
    """Host in reversed order, without port and www number."""
    h = F.regexp_replace(F.regexp_replace(F.lower(host), r":\d+$", ""), r"^www\d*\.", "")
    return F.array_join(F.reverse(F.split(h, r"\.", -1)), ",")


def mangled(path: Column, query: Column, variant: str = "keep") -> Column:
    """File name for a path with a query. keep: slashes of the query stay; flat: / and ? become _; slash: only / becomes _; html: flat with .html; bare: the query alone."""
    flat = F.translate(query, "/?", "__")
    has = F.coalesce(query != "", F.lit(False))
    if variant == "bare":
        return F.when(has, query).otherwise(path)
    q = {"keep": query, "flat": flat, "slash": F.translate(query, "/", "_"), "html": F.concat(flat, F.lit(".html"))}[variant]
    return F.when(has, F.concat(path, F.lit("@"), q)).otherwise(path)


def dedup_segments(path: Column) -> Column:
    """The first of two equal neighbouring parts of a path taken out."""
    found = F.regexp_extract(path, r"(?:^|/)([^/]+)/\1(?:/|$)", 1)
    at = F.position(F.concat(found, F.lit("/"), found), path)
    return F.when(found != "", F.concat(F.substring(path, F.lit(1), at - 1), F.substring(path, at + F.length(found) + 1, F.length(path)))).otherwise(path)


def path_of(url: Column) -> Column:
    """Path of an address, null where it is none."""
    return F.try_parse_url(url, F.lit("PATH"))


def norm_path(href: Column) -> Column:
    """Relative path of a link without fragment and ./, null for absolute ones."""
    p = F.regexp_replace(F.regexp_replace(href, "#.*$", ""), r"^(\./)+", "")
    return F.when(p.rlike("^(?:/|[a-z][a-z0-9+.-]*:)") | (p == ""), None).otherwise(p)


@F.pandas_udf(T.StringType())
def url_path(path: pd.Series) -> pd.Series:
    """Each part percent-encoded."""
    return path.map(lambda p: "/".join(quote(x, safe="!$&'()*+,;=:@~") for x in p.split("/")), na_action="ignore")


@F.pandas_udf(T.StringType())
def relative(to: pd.Series, start: pd.Series) -> pd.Series:
    """Path of `to` seen from the directory of `start`."""
    return pd.Series([None if a is None or b is None else posixpath.relpath(a, posixpath.dirname(b) or ".") for a, b in zip(to, start)], dtype=object)


def malformed(url: Column) -> Column:
    """Whether an address has no place in a tree: nested, rootless, or a machine's file."""
    path = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")
    return path.rlike(r"/https?:/") | path.startswith("//") | path.rlike(r"(?:^|/)(?:robots\.txt|favicon\.ico)$")


def is_junk(target: Column) -> Column:
    """Whether a link's target cannot be a file: templates, scripts, search strings."""
    return target.rlike(r"[<>{}$]|javascript:|^\?|//|\s$")


#: Schemes that lead to no page.
NO_PAGE = r"(?i)^(?:mailto|javascript|data|ftp|news|about|file|tel):"


def unmangled(path: Column) -> Column:
    """The address of a file that was named after an address with a query; null where the name tells nothing.

    name@query of a script or page, name@query.html of a script, and ?-less names as they are; a bare number is opaque.
    """
    script = r"^(.*\.(?:cgi|php|pl))@([^@]+?)(?:\.html)?$"
    page = r"^(.*)@([^@]+=[^@]*?)\.html$"
    opaque = path.rlike(r"@\d+\.html?$")
    return F.when(path.rlike(script), F.regexp_replace(path, script, "$1?$2")).when(path.rlike(page), F.regexp_replace(path, page, "$1.html?$2")).when(opaque, None).when(~path.contains("@"), path)


def encoded_path(path: Column) -> Column:
    """A path with each part percent-encoded; ASCII paths without odd signs never leave the JVM."""
    return F.when(path.rlike(r"^[A-Za-z0-9!$&'()*+,;=:@~._/\-]*$"), path).otherwise(url_path(path))


def page_url(path: Column, anchor: Column, root: str) -> Column:
    """Address of a stored path under a root; external ones on their own host."""
    p = F.when(path.startswith("external/"), F.concat(F.lit("http://"), encoded_path(F.regexp_replace(path, "^external/", "")))).otherwise(F.concat(F.lit(root), encoded_path(path)))
    return F.concat(p, F.coalesce(F.concat(F.lit("#"), anchor), F.lit("")))


def entry_type(path: Column, kind: Column) -> Column:
    """image by suffix, else external or html."""
    return F.when(path.rlike(r"(?i)\.(?:gif|jpe?g|png|bmp)$"), "image").when(kind == "external", "external").otherwise("html")


def target_path(line: Column, home: str, most: int = 500) -> Column:
    """The path that an address typed by a person means on the home host; null for other hosts, schemes, dots and overlong ones."""
    s = F.trim(line)
    full = F.regexp_extract(s, rf"(?i)^https?://(?:www\.)?{home.replace('.', '[.]')}(?::\d+)?(/[^?#]*)?", 1)
    own = s.rlike(rf"(?i)^https?://(?:www\.)?{home.replace('.', '[.]')}(?::\d+)?(?:/|$)")
    path = F.try_url_decode(F.when(own, full).when(s.startswith("/") & ~s.startswith("//"), F.regexp_replace(s, r"[?#].*$", "")))
    return F.when(~path.rlike(r"(?:^|/)\.{1,2}(?:/|$)") & (F.length(s) <= most) & (path != ""), path)


def absolute_links(html: Column, base: Column) -> Column:
    """A page with its relative links made absolute."""
    return F.regexp_replace(html, F.lit(r"(?i)\b(href|src)\s*=\s*\"(?![a-z][a-z0-9+.\-]*:|/|#)(?:\./)?([^\"]*)\""), F.concat(F.lit('$1="'), base, F.lit('$2"')))


def published(html: Column) -> Column:
    """A page without advertising scripts, its character set named once, at its old place or behind the head's tag."""
    s = F.regexp_replace(html, r"(?is)<script\b[^>]*\bsrc\s*=[^>]*(?:ads|adserver|doubleclick|googlesyndication)[^>]*>.*?</script\s*>", "")
    meta = r"(?is)^(.*?)<meta\b[^>]*charset[^>]*>"
    named = F.regexp_replace(s, meta, '$1<meta charset="utf-8">')
    return F.when(s.rlike(r"(?is)<meta\b[^>]*charset"), named).otherwise(F.regexp_replace(s, r"(?is)^(.*?<head\b[^>]*>)", '$1<meta charset="utf-8">'))


def page_title(html: Column) -> Column:
    """What a page's title tag holds, blanks collapsed; null without one."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"(?U)[\s　]+", " "))
    return F.when(t != "", t)


def day_of_path(path: Column) -> Column:
    """struct<date, precision> of a path with a year-and-month directory: its first day; unknown without one."""
    ym = F.regexp_extract(path, r"(?:^|/)(\d{4})(0[1-9]|1[0-2])/", 0)
    day = F.when(ym != "", F.concat(F.regexp_extract(path, r"(?:^|/)(\d{4})(0[1-9]|1[0-2])/", 1), F.lit("-"), F.regexp_extract(path, r"(?:^|/)(\d{4})(0[1-9]|1[0-2])/", 2), F.lit("-01")))
    return F.struct(day.alias("date"), F.when(day.isNotNull(), "directory-batch").otherwise("unknown").alias("precision"))


def pivoted_year(year: Column) -> Column:
    """Two-digit years below 50 in this century, others in the last; longer ones as they are."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
