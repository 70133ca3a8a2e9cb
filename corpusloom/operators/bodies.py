"""Bodies of pages: navigation off, tables told apart, hard wraps joined, Markdown made, checked again and split.

Everything is JVM expressions but the independent re-check, which reads the page with another parser in Arrow batches,
and the search for what two texts differ in, which only texts that do not contain each other reach.

Defined results: null gives null; a page without text converts to the mode `empty`; texts of any length are read whole.
"""

from __future__ import annotations

import difflib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import markup

# Words and signs of navigation, ends of sentences, tags that stay in Markdown.
NAV_WORDS = ["戻る", "もどる", "次へ", "前へ", "進む", "目次", "トップ", "ホーム", "先頭", "TOP", "HOME", "BACK", "NEXT", "PREV", "INDEX", "MENU"]
NAV_SIGNS = r"[\s　<>＜＞≪≫«»|｜\[\]【】()（）・:：/／\-–—=＝*＊◆■□→←↑↓]"
SENTENCE_ENDS = "。！？!?」』）)…"
KEPT_TAGS = "ruby|rb|rt|rp|img"
#: Letters up to which a stretch may be navigation, and lengths that tell tables apart.
CHROME_LETTERS, DATA_CELLS, DATA_MEAN = 200, 6, 20
#: Letters that may be missing at either end without a word.
SLACK = 10

_NAV = f"(?i)^{NAV_SIGNS}*(?:(?:{'|'.join(NAV_WORDS)}){NAV_SIGNS}*)+$"
_HR = r"(?i)<hr\b[^>]*>"


def plain_letters(s: Column) -> Column:
    """A markup text without tags and white space."""
    return F.regexp_replace(F.regexp_replace(s, "<[^>]+>", ""), r"(?U)[\s　]+", "")


def is_chrome(s: Column) -> Column:
    """Whether a stretch of a page may be navigation: short and without the end of a sentence."""
    letters = plain_letters(s)
    return (F.length(letters) <= CHROME_LETTERS) & ~letters.rlike("[。！？]")


def stripped(body: Column) -> Column:
    """struct<region, head, tail>: a body without the leading and trailing stretches between rules that are navigation.

    Without a rule, or where every stretch is navigation, all of it stays.
    """
    parts = F.regexp_extract_all(body, F.lit(r"(?is)(.*?<hr\b[^>]*>|.+$)"), 1)
    text = F.transform(parts, lambda p: ~is_chrome(F.regexp_replace(p, _HR, "")))
    first = F.array_position(text, True)
    last = F.size(parts) - F.array_position(F.reverse(text), True) + 1
    whole = (F.size(parts) < 2) | (first == 0)
    join = lambda a, n: F.array_join(F.slice(parts, a, n), "")
    # an empty text has no stretch at all
    return F.when(whole, F.struct(body.alias("region"), F.lit("").alias("head"), F.lit("").alias("tail"))).otherwise(
        F.struct(join(first.cast("int"), (last - first + 1).cast("int")).alias("region"), join(F.lit(1), (first - 1).cast("int")).alias("head"), join((last + 1).cast("int"), (F.size(parts) - last).cast("int")).alias("tail"))
    )


def is_nav_line(line: Column) -> Column:
    """Whether a line holds nothing but navigation words and signs."""
    return line.rlike(_NAV)


def trimmed(text: Column) -> Column:
    """struct<text, head, tail>: a text without navigation lines, rules and blank lines at its ends, and the lines taken off."""
    lines = F.split(text, "\n", -1)
    flat = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    solid = F.transform(flat, lambda x: ~((x == "") | x.rlike("^-{4,}$") | is_nav_line(x)))
    first = F.array_position(solid, True).cast("int")
    last = (F.size(lines) - F.array_position(F.reverse(solid), True) + 1).cast("int")
    gone = lambda a, n: F.filter(F.slice(flat, a, n), is_nav_line)
    none = F.array().cast("array<string>")
    return F.when(first == 0, F.struct(F.lit("").alias("text"), F.filter(flat, is_nav_line).alias("head"), none.alias("tail"))).otherwise(
        F.struct(F.concat(F.array_join(F.slice(lines, first, last - first + 1), "\n"), F.lit("\n")).alias("text"), gone(F.lit(1), first - 1).alias("head"), gone(last + 1, F.size(lines) - last).alias("tail"))
    )


def table_kind(table: Column) -> Column:
    """data for many short cells, layout for all other tables."""
    cells = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dhr]|</table|$)"), 1), lambda c: F.length(plain_letters(c)))
    n = F.size(cells)
    mean = F.aggregate(cells, F.lit(0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    return F.when((n >= DATA_CELLS) & (mean < DATA_MEAN), "data").otherwise("layout")


def reflowed(text: Column) -> Column:
    """Lines joined with the next one unless a sentence ends, a paragraph ends or speech or an indent begins there."""
    return F.regexp_replace(text, rf"(?<=[^{SENTENCE_ENDS}\n])\n(?=[^\n「『　])", "")


def to_markdown(body: Column) -> Column:
    """struct<md, mode>: rules, headings and quotations as marks, ruby and images as they are, other tags off.

    mode: empty, hard-wrapped (lines joined) or br-para.
    """
    s = F.regexp_replace(body, "\r\n?", "\n")
    # what is between quotation tags stands at the odd places
    pieces = F.split(s, r"(?i)</?blockquote\b[^>]*>", -1)
    quoted = lambda p: F.concat(F.lit("\n\n"), F.array_join(F.transform(F.split(F.regexp_replace(_inline(p), r"^\n+|\n+$", ""), "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n"), F.lit("\n\n"))
    s = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, quoted(p)).otherwise(_inline(p))), "")
    lines = F.transform(F.split(s, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^[\s　]+$|[ \t]+$", ""))
    flat = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    wrapped = markup.hard_wrapped(flat)
    md = F.when(wrapped, reflowed(flat)).otherwise(flat)
    empty = plain_letters(md) == ""
    return F.struct(F.when(empty, F.lit("")).otherwise(F.concat(md, F.lit("\n"))).alias("md"), F.when(empty, "empty").when(wrapped, "hard-wrapped").otherwise("br-para").alias("mode"))


def _inline(s: Column) -> Column:
    s = F.regexp_replace(s, _HR, "\n\n----\n\n")
    s = F.regexp_replace(s, r"(?is)<h[1-6]\b[^>]*>\s*(.*?)\s*</h[1-6]\s*>", "\n\n## $1\n\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), r"(?i)</?(?:p|div|table|tr|ul|ol|li|center)\b[^>]*>", "\n\n")
    return F.regexp_replace(s, rf"(?i)<(?!/?(?:{KEPT_TAGS})\b)/?[a-z][^>]*>", "")


def unmarked(md: Column) -> Column:
    """A Markdown text without its marks and kept tags."""
    s = F.regexp_replace(F.regexp_replace(md, r"(?m)^----$", ""), r"(?m)^(?:## |> )", "")
    return F.regexp_replace(s, rf"(?i)</?(?:{KEPT_TAGS})\b[^>]*>", "")


def part_at(html: Column, anchor: Column) -> Column:
    """struct<part, found>: a page from the named anchor up to the next one; the whole page where there is none. Case does not matter."""
    parts = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s+(?:name|id)\s*=.*?)(?=<a\s+(?:name|id)\s*=|$)"), 1)
    name = F.lower(F.regexp_replace(anchor, "^#", ""))
    hit = F.filter(parts, lambda p: F.lower(F.regexp_extract(p, r"(?is)^<a\s+(?:name|id)\s*=\s*[\"']?([^\"'\s>]+)", 1)) == name)
    return F.struct(F.when(F.size(hit) > 0, F.get(hit, F.lit(0))).otherwise(html).alias("part"), (F.size(hit) > 0).alias("found"))


def route(path: Column, held: Column, stand_in: Column) -> Column:
    """struct<status, mode> of how a body comes about: a stand-in text, an image, an outside link, nothing, plain text or a page."""
    image = path.rlike(r"(?i)\.(?:gif|jpe?g|png)$")
    st = lambda a, b: F.struct(F.lit(a).alias("status"), F.lit(b).cast("string").alias("mode"))
    return (
        F.when(stand_in.isNotNull(), st("md", "plain-text"))
        .when(path.rlike("^(?:[a-z]+://|external/)"), st("stub", "external-link"))
        .when(path.isNull() | (path == "") | ~F.coalesce(held, F.lit(False)), st("no-source", None))
        .when(image, st("md", "image-work"))
        .when(path.rlike(r"(?i)\.txt$"), st("md", "plain-text"))
        .otherwise(st("md", "br-para"))
    )


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def visible(html: pd.Series) -> pd.Series:
    """What a reader of a page sees, by a parser that knows nothing of the conversion."""

    def one(s: str) -> str:
        p = _Visible()
        p.feed(s)
        p.close()
        return "".join(p.out)

    return pd.Series([one(s) if isinstance(s, str) else None for s in html], dtype=object)


def squeezed(s: Column) -> Column:
    """Without white space, zero-width letters and angle brackets."""
    return F.regexp_replace(s, r"(?U)[\s　​-‍⁠﻿<>]+", "")


def rechecked(html: Column, md: Column, anchored: Column | None = None) -> Column:
    """struct<result, dropped_head, dropped_tail>: whether a conversion is one stretch of what the page shows, and what is left over.

    match, match-anchor (the rest belongs to other anchors), match-but-chrome-suspect, match-empty, empty-md-suspect,
    mismatch or no-md.
    """
    a, b = squeezed(visible(html)), squeezed(unmarked(md))
    at = F.instr(a, b)
    head, tail = F.substring(a, F.lit(1), at - 1), F.substring(a, at + F.length(b), F.length(a))
    chrome = lambda x: (F.length(x) <= CHROME_LETTERS) & ~x.rlike("[。！？]")
    ok = chrome(head) & chrome(tail)
    result = (
        F.when(md.isNull(), "no-md")
        .when(b == "", F.when(chrome(a), "match-empty").otherwise("empty-md-suspect"))
        .when(at == 0, "mismatch")
        .when(ok, "match")
        .when(F.coalesce(anchored, F.lit(False)) if anchored is not None else F.lit(False), "match-anchor")
        .otherwise("match-but-chrome-suspect")
    )
    held = (at > 0) & (b != "")
    return F.struct(result.alias("result"), F.when(held, F.length(head)).alias("dropped_head"), F.when(held, F.length(tail)).alias("dropped_tail"))


_PUNCT = {"“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-"}


def plain_punctuation(s: Column) -> Column:
    """Typographic signs as typed ones, runs of hyphens as one, pictures off."""
    s = F.translate(s, "".join(_PUNCT), "".join(_PUNCT.values()))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "…", "..."), "-{2,}", "-"), r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "")


@F.pandas_udf(T.StringType())
def difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """order where the same letters stand elsewhere, else whether the longer stretch is missing or extra in `b`."""
    out = []
    for x, y in zip(a, b):
        if not isinstance(x, str) or not isinstance(y, str):
            out.append(None)
        elif sorted(x) == sorted(y):
            out.append("order")
        else:
            ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
            missing = max((i2 - i1 for tag, i1, i2, _, _ in ops if tag in ("delete", "replace")), default=0)
            extra = max((j2 - j1 for tag, _, _, j1, j2 in ops if tag in ("insert", "replace")), default=0)
            out.append("extra" if extra > missing else "missing")
    return pd.Series(out, dtype=object)


def verdict(original: Column, shown: Column) -> Column:
    """ok, ok-trimmed, ok-texturize, ng-missing, ng-extra or ng-order of a shown text against its original, both squeezed.

    Only texts of which neither holds the other reach the search for the difference.
    """
    a, b = squeezed(original), squeezed(shown)
    pa, pb = plain_punctuation(a), plain_punctuation(b)
    at = F.instr(a, b)
    head, tail = at - 1, F.length(a) - F.length(b) - at + 1
    hard = F.when((b != "") & (at == 0) & (F.instr(pa, pb) == 0), difference(a, b))
    return (
        F.when(a.isNull() | b.isNull(), "error")
        .when(b == "", F.when(a == "", "ok").otherwise("ng-missing"))
        .when(at > 0, F.when((head <= SLACK) & (tail <= SLACK), "ok").otherwise("ok-trimmed"))
        .when(F.instr(pa, pb) > 0, "ok-texturize")
        .otherwise(F.concat(F.lit("ng-"), hard))
    )


def blocks(md: Column) -> Column:
    """array<struct<kind, text>> of a Markdown text: rule, heading, quote, image or paragraph, empty ones left out."""
    parts = F.filter(F.split(F.regexp_replace(md, r"^\n+|\n+$", ""), "\n{2,}", -1), lambda p: p != "")
    kind = lambda p: F.when(p == "----", "rule").when(p.startswith("## "), "heading").when(p.startswith("> "), "quote").when(p.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "image").otherwise("paragraph")
    bare = lambda p: F.when(p == "----", "").otherwise(F.regexp_replace(p, r"(?m)^(?:## |> )", ""))
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), bare(p).alias("text")))


def image_warnings(md: Column) -> Column:
    """Addresses of images that lie outside."""
    found = F.regexp_extract_all(md, F.lit(r"(?i)(?:!\[[^\]]*\]\(|<img\b[^>]*src\s*=\s*[\"']?)([^)\"'\s>]+)"), 1)
    return F.filter(found, lambda x: x.rlike("^[a-z]+://"))


_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("changed", "added", "removed")])


@F.pandas_udf(_COUNTS)
def line_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many lines differ, were added and were removed between two texts, by their longest common subsequence."""
    rows = []
    for x, y in zip(a, b):
        if not isinstance(x, str) or not isinstance(y, str):
            rows.append((None, None, None))
            continue
        p, q = (s.rstrip("\r\n").splitlines() if s else [] for s in (x, y))
        ids: dict[str, int] = {}
        u, v = (np.array([ids.setdefault(s, len(ids)) for s in z], dtype=np.int64) for z in (p, q))
        row = np.zeros(len(v) + 1, dtype=np.int64)
        for s in u:
            # the new row is the running maximum of the old one and the old one's matches one step on
            step = np.where(v == s, row[:-1] + 1, row[1:])
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(step, row[1:]))])
        common = int(row[-1])
        rows.append((len(p) + len(q) - 2 * common, len(q) - common, len(p) - common))
    return pd.DataFrame(rows, columns=["changed", "added", "removed"]).astype("Int64")
