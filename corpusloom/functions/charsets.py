"""Bytes as text. Valid UTF-8 is decoded in the JVM; only what is left goes through Python, in Arrow batches."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", re.I)
# Names of character sets as pages give them.
ALIASES = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "utf8": "utf-8", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp"}
#: Sets that are tried where a page names none, and the ways to read what none of them can.
TRIED = ["utf-8", "cp932", "euc_jp"]
LOSSY = {"chain": ["cp932"], "meta": ["cp932"], "fewest": ["cp932", "euc_jp"]}


def strictly(data: bytes, names: list[str]) -> tuple[str, str] | None:
    """(text, set) by the first of the sets that reads every byte."""
    for name in names:
        try:
            return codecs.lookup(name).decode(data, "strict")[0], name
        except (UnicodeDecodeError, LookupError):
            pass
    return None


def named(data: bytes) -> list[str]:
    """The set that a page's head names, if it names one that exists."""
    hit = _META.search(data[:2048])
    name = hit.group(1).decode("ascii").lower() if hit else ""
    name = ALIASES.get(name, name)
    try:
        return [codecs.lookup(name).name and name] if name else []
    except LookupError:
        return []


def guess(data: bytes, how: str = "chain") -> tuple[str, str]:
    """(text, encoding). chain: the first set that reads strictly, else cp932 with replacements. fewest: else whichever
    lossy reading has fewer replacements, the first on a tie. meta: before all what the page's own head names."""
    own = named(data) if how == "meta" else []
    exact = strictly(data, own + TRIED)
    if exact:
        return exact
    if own:
        return data.decode(own[0], "replace"), own[0]
    lossy = {f"{name}-replace": data.decode(name, "replace") for name in LOSSY[how]}
    best = min(lossy, key=lambda name: lossy[name].count("�"))
    return lossy[best], best


def decoder(how: str = "chain"):
    """Arrow UDF binary -> struct<text, encoding>; null gives null."""

    @F.pandas_udf(_RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else guess(bytes(x), how) for x in s], columns=["text", "encoding"])

    return run


def decoded(data: Column, how: str = "chain") -> Column:
    """struct<text, encoding> of bytes. Where UTF-8 comes first anyhow, valid bytes are read in the JVM."""
    if how == "meta":
        # a page may name a set of seven bits, whose bytes are valid UTF-8, too
        plain = F.is_valid_utf8(data.cast("string")) & ~F.lower(data.cast("string")).rlike(r"charset\s*=\s*[\"']?\s*(?!utf-?8)[a-z]")
    else:
        plain = F.is_valid_utf8(data.cast("string"))
    return F.when(data.isNull(), F.lit(None).cast(_RESULT)).when(plain, F.struct(data.cast("string").alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(decoder(how)(F.when(~plain, data)))


def lenient(data: Column) -> Column:
    """UTF-8 with replacements for what is none; null and unreadable bytes give an empty text."""
    return F.coalesce(F.make_valid_utf8(data.cast("string")), F.lit(""))
