"""HTML as text: cleaning, bodies, links, lines, the comparison forms of lossless conversion. JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"""(?i)\b(?:href|src|action|background)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def precleaned(s: Column) -> Column:
    """Markup without scripts, styles, comments, bogus comments and forms; a bare < becomes a reference."""
    for p in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<![^>]*>", r"(?is)<form\b.*?</form\s*>"):
        s = F.regexp_replace(s, p, "")
    return F.regexp_replace(s, r"<(?!/?[A-Za-z])", "&lt;")


def body_of(s: Column) -> Column:
    """What the body tags hold; without an end all after the start, without a start all before the end, without both everything."""
    full = F.regexp_extract(s, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)
    open_ = F.regexp_extract(s, r"(?is)<body\b[^>]*>(.*)$", 1)
    closed = F.regexp_extract(s, r"(?is)^(.*)</body\s*>", 1)
    return F.when(full != "", full).when(open_ != "", open_).when(closed != "", closed).otherwise(s)


def links(s: Column) -> Column:
    """Values of link attributes in order, quotes off."""
    return F.transform(F.regexp_extract_all(s, F.lit(LINK), 1), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def lines_of(s: Column) -> Column:
    """Non-blank lines of a markup text: block tags end a line, other tags vanish."""
    t = F.regexp_replace(s, r"(?i)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-6]|hr|/?blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), "\r\n?", "\n")
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def compared(s: Column) -> Column:
    """The form in which a text and its conversion must be equal: no tags, white space, zero-width characters or angle brackets."""
    return F.regexp_replace(F.regexp_replace(s, "<[^>]+>", ""), r"(?U)[\s​-‍⁠﻿<>]+", "")


def converted(s: Column) -> Column:
    """Plain paragraphs of a markup text."""
    return F.array_join(lines_of(precleaned(s)), "\n\n")


def proof(original: Column, made: Column) -> Column:
    """equal, contained (with cut ends), or lost: whether a conversion kept the original's text."""
    # the two forms are the fields of one element, so each is made once however often it is compared
    forms = F.array(F.struct(compared(precleaned(original)).alias("a"), compared(made).alias("b")))
    judged = lambda f: F.when(f["a"] == f["b"], "equal").when((f["b"] != "") & f["a"].contains(f["b"]), "contained").when(f["a"].isNotNull() & f["b"].isNotNull(), "lost")
    return F.get(F.transform(forms, judged), F.lit(0))


def hard_wrapped(s: Column, least: int = 30, width: int = 30) -> Column:
    """Whether more than `least` lines are longer than `width`."""
    return F.size(F.filter(F.split(s, "\n", -1), lambda x: F.length(x) > width)) > least
