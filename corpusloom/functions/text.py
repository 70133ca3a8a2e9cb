"""Text columns: markup off, white space, addresses, tokens, slugs, title cores. JVM expressions but for the UDFs named."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Address and keep patterns, title markers, full-width forms.
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
FILE_SUFFIX = r"\.(?:html?|cgi|jpg|gif|png)$"
KEEP_WORDS = ["hoge", "example", "localhost", "virtual.domain"]
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
THIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
TITLE_MARKERS = [
    r"[\s　]*[（(][0-9０-９]+[)）]$",
    r"[\s　]*第[0-9０-９一二三四五六七八九十百]+[話回章部夜]$",
    r"[\s　]*その[0-9０-９一二三四五六七八九十]+$",
    r"(?i)[\s　]*(?:lesson|episode|stage|no\.?|vol\.?|act|part)[\s　]*[0-9０-９]+$",
    r"[\s　]+[0-9０-９一二三四五六七八九十]+$",
]


def strip_tags(s: Column) -> Column:
    """Text without tags."""
    return F.regexp_replace(s, "<[^>]+>", "")


def null_if_empty(s: Column) -> Column:
    """Null for the empty string."""
    return F.when(s != "", s)


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Character references resolved; null stays null."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def norm_name(s: pd.Series) -> pd.Series:
    """Compatibility form without white space, case folded."""
    return s.map(lambda x: re.sub(r"\s+", "", unicodedata.normalize("NFKC", x)).casefold(), na_action="ignore")


def cell_text(s: Column, keep_breaks: bool = False) -> Column:
    """Text of a table cell: breaks kept as lines or made blanks, tags off, references resolved, lines and ends trimmed, empty is null."""
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n" if keep_breaks else " ")
    s = F.regexp_replace(html_unescape(strip_tags(s)), "\r\n?", "\n")
    lines = F.transform(F.split(s, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return null_if_empty(F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", ""))


def squeezed(s: Column) -> Column:
    """Text without any white space or zero-width characters."""
    return F.regexp_replace(s, r"(?U)[\s​-‍⁠﻿]+", "")


def one_line(s: Column, tag: str = "") -> Column:
    """Tags replaced by `tag`, white space collapsed, ends trimmed, empty is null."""
    s = F.regexp_replace(F.regexp_replace(s, "<[^>]+>", tag), r"(?U)\s+", " ")
    return null_if_empty(F.trim(s))


def hankaku(s: Column) -> Column:
    """Full-width ASCII as ASCII."""
    return F.translate(s, WIDE, THIN)


def split_tokens(s: Column) -> Column:
    """Tokens between ASCII or ideographic blanks, in order, repeats kept."""
    return F.filter(F.split(s, r"[\s　]+", -1), lambda x: x != "")


def addresses(s: Column) -> Column:
    """Mail addresses in a text, without file names and words that mark examples."""
    found = F.regexp_extract_all(s, F.lit(f"({ADDRESS})"), 1)
    keep = "|".join(w.replace(".", r"\.") for w in KEEP_WORDS)
    return F.filter(found, lambda x: ~F.lower(x).rlike(FILE_SUFFIX) & ~F.lower(x).rlike(keep))


def redacted(s: Column, to: str = "[address]") -> Column:
    """The text with its addresses replaced; addresses are replaced longest first so none is cut by another."""
    longest = F.array_sort(F.array_distinct(addresses(s)), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, s, lambda acc, x: F.replace(acc, x, F.lit(to)))


def has_leak(s: Column) -> Column:
    """Whether a text still holds a mail link or address."""
    return F.coalesce(F.lower(s).contains("mailto:") | (F.size(addresses(s)) > 0), F.lit(False))


def slugify(s: Column) -> Column:
    """ASCII slug: lower case, runs of other characters as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_core(s: Column) -> Column:
    """A title without its number of volume or part; the title itself where nothing else is left."""
    core = F.trim(hankaku(s))
    for marker in TITLE_MARKERS:
        core = F.regexp_replace(core, marker, "")
    return F.when(core != "", core).otherwise(s)


def control_free(s: Column) -> Column:
    """Text without control characters but tab and line feed."""
    return F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def salted_hash(s: Column, salt: str) -> Column:
    """One-way hash of an identifier."""
    return F.sha2(F.concat(F.lit(salt + "|"), s), 256)


def sections(s: Column, names: list[str]) -> Column:
    """map of marker name -> text after 【name】 up to the next marker."""
    pairs = F.regexp_extract_all(s, F.lit("(【[^】]+】[^【]*)"), 1)
    rows = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "【([^】]+)】", 1).alias("key"), F.trim(F.regexp_replace(p, "^【[^】]+】", "")).alias("value")))
    kept = F.filter(rows, lambda r: r["key"].isin(names))
    firsts = F.aggregate(kept, F.map_from_entries(F.slice(kept, 1, 0)), lambda m, r: F.when(F.map_contains_key(m, r["key"]), m).otherwise(F.map_concat(m, F.create_map(r["key"], r["value"]))))
    return firsts


def reading_minutes(chars: Column) -> Column:
    """Minutes at 550 characters a minute, at least 1, null under 200 characters."""
    return F.when(chars >= 200, F.greatest(F.lit(1), F.floor(chars / 550.0 + 0.5).cast("int")))


def title_key(s: Column) -> Column:
    """A title as versions of it share it: width folded, lower case, no blanks or punctuation."""
    return F.lower(F.regexp_replace(hankaku(s), r"[\s　!?！？。、・~〜「」『』()\-]+", ""))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(s: Column) -> Column:
    """Canonical composed form; texts without marks that could compose never leave the JVM."""
    return F.when(s.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2000}-\x{2FFF}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}゛゜]"), _nfc(s)).otherwise(s)


def nfkc_lower(s: Column) -> Column:
    """Compatibility form in lower case."""
    return F.lower(nfkc(s))


#: What stands around a page's own title, and titles that say nothing.
SITE = "少年少女文庫"
NO_TITLES = ["無題ドキュメント", "無題", "untitled", "untitled document", SITE]


def clean_title(s: Column) -> Column:
    """A page's title without the site's name before or behind it and without tags; null where nothing is left."""
    t = F.regexp_replace(strip_tags(s), r"(?U)^[\s　]+|[\s　]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"^■?\s*{SITE}\s*[・\-–—:：|｜]\s*", ""), rf"\s*[・\-–—:：|｜]\s*{SITE}$", "")
    return F.when(~F.lower(t).isin([x.lower() for x in NO_TITLES]) & (t != ""), t)


#: Words that mean an entry of the vocabulary.
SYNONYMS = {"学校": "学園", "ショート": "短編"}


def vocabulary_form(s: Column) -> Column:
    """A typed term as the vocabulary has it: width folded, corner brackets and a doubtful ending off, synonyms told."""
    t = F.regexp_replace(F.regexp_replace(hankaku(s), "[「」]", ""), r"\s*(?:\(\?\)|\?)+$", "")
    t = F.trim(t)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), t), t)


def is_unspecified(s: Column) -> Column:
    """Whether a value is nothing but question marks, brackets and blanks."""
    return s.rlike(r"^[?？()（）\s　]+$")


_MAILTO = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']?mailto:([^\"'>\s]*)[\"']?[^>]*>(.*?)</a\s*>"


def scrubbed_mailto(s: Column) -> Column:
    """struct<html, dropped>: mail links as their labels, or nothing where the label is an address; open mail attributes
    as href="#"; bare addresses off. dropped holds every address that went, in the order links, labels, attributes, bare."""
    real = lambda x: (x != "") & ~F.lower(x).rlike(FILE_SUFFIX)
    wanted = F.regexp_extract_all(s, F.lit(_MAILTO), 1)
    labels = F.filter(F.transform(F.regexp_extract_all(s, F.lit(_MAILTO), 2), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x.rlike(f"^{ADDRESS}$"))
    one = F.regexp_replace(s, rf"(?is)<a\b[^>]*\bhref\s*=\s*[\"']?mailto:[^\"'>\s]*[\"']?[^>]*>\s*{ADDRESS}\s*</a\s*>", "")
    one = F.regexp_replace(one, _MAILTO, "$2")
    attribute = r"(?is)\bhref\s*=\s*[\"']?mailto:([^\"'>\s]*)[\"']?"
    open_ = F.regexp_extract_all(one, F.lit(attribute), 1)
    two = F.regexp_replace(one, attribute, 'href="#"')
    bare = F.filter(F.regexp_extract_all(two, F.lit(f"({ADDRESS})"), 1), real)
    html_ = F.aggregate(F.array_sort(F.array_distinct(bare), lambda a, b: F.length(b) - F.length(a)), two, lambda acc, x: F.replace(acc, x, F.lit("")))
    return F.struct(F.regexp_replace(html_, r"^\s+$", "").alias("html"), F.concat(F.filter(wanted, lambda x: x != ""), labels, open_, bare).alias("dropped"))


def scrubbed(s: Column) -> Column:
    """A text with mail links as their labels, mail attributes off and bare addresses replaced."""
    t = F.regexp_replace(F.regexp_replace(s, _MAILTO, "$2"), r"(?is)\s\w+\s*=\s*[\"']?mailto:[^\"'>\s]*[\"']?", "")
    return redacted(t)


def common_prefix(strings: Column) -> Column:
    """The beginning that all strings of an array share; null for an empty array."""
    both = lambda a, b: F.substring(a, F.lit(1), F.array_max(F.filter(F.sequence(F.lit(0), F.length(a)), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))))
    return F.aggregate(strings, F.get(strings, F.lit(0)), both)


def romanized(s: Column, fallback: str = "untitled") -> Column:
    """struct<slug, source>: an ASCII slug where the text has ASCII letters, else the fallback with the text's hash."""
    made = slugify(hankaku(s))
    return F.when(made != "", F.struct(made.alias("slug"), F.lit("ascii").alias("source"))).otherwise(
        F.struct(F.concat(F.lit(f"{fallback}-"), F.substring(F.md5(s), 1, 8)).alias("slug"), F.lit("fallback").alias("source"))
    )


def markdown_cell(s: Column) -> Column:
    """A value for a cell of a Markdown table."""
    return F.replace(F.replace(F.coalesce(s, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def yaml_string(s: Column) -> Column:
    """A value as a quoted string."""
    t = s
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), t, F.lit('"'))


def board_names(title: Column) -> Column:
    """Names in a board's title: those before さん, else what stands before の感想."""
    named = F.regexp_extract_all(title, F.lit(r"([^\s　・、&＆]+?)さん"), 1)
    plain = F.filter(F.split(F.regexp_extract(title, "^(.*?)の感想", 1), "[・、&＆]", -1), lambda x: x != "")
    return F.when(F.size(named) > 0, named).otherwise(plain)


def first_rule(subject: Column, rules: dict[str, str]) -> Column:
    """struct<kind, mixed>: the kind of the first word that a subject holds, whatever its case, else other; mixed if it holds several."""
    s = F.lower(subject)
    hits = F.array_compact(F.array(*[F.when(s.contains(word), F.lit(kind)) for word, kind in rules.items()]))
    return F.struct(F.coalesce(F.get(hits, F.lit(0)), F.lit("other")).alias("kind"), (F.size(hits) > 1).alias("mixed"))
