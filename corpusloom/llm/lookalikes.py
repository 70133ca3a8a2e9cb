"""Text that looks the same, in one consistent form.

Look-alike classes are the connected components (union-find) of a graph over strings and code points: width and blank
variants and canonical equivalents by the character database, radicals for ideographs, and lists of letters that share
a shape. Edges between single characters carry over to base-and-mark strings. Of each class the member most frequent
in the corpus stands for all; a multi-pattern automaton rewrites texts greedily, leftmost and longest first, until
nothing changes. Super- and subscripts, circled digits, case and differing marks stay different.

Defined results: null stays null; a text of nothing but blanks or invisible characters becomes empty; blanks at both
ends go; texts of any length are rewritten whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bounded import checkpointed

# Characters of one shape, one class in each group.
SAME_SHAPE = [
    # Latin, Cyrillic, Greek
    "AАΑᎪ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YҮΥ", "ZΖ",
    "aаɑ", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iіι", "jјϳ", "lӏ", "oоο", "pрρ", "qԛ", "sѕ", "uυ", "vνѵ", "wԝ", "xх", "yуγ", "nո",
    # kana and ideographs
    "カ力", "タ夕", "ロ口", "エ工", "ニ二", "ハ八", "ト卜", "ー一―—", "ヘへ", "ベべ", "ペぺ", "ノ丿",
    # marks
    "-‐‑‒–−﹣", ".․", "/∕⁄", "'’‘ʼ", '"“”', "・･·‧", "~〜∼", ":∶", ",‚", "_＿", "|ǀ∣",
]
#: Blanks that look like one space.
BLANKS = " \t               　"
#: Tags of compatibility decompositions that keep the look; the others (circle, super, sub, square, fraction...) do not.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>"}
ROMAN = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180)}


def invisible(c: str) -> bool:
    """Characters that leave no trace: format characters, controls but for line ends, variation selectors."""
    kind = unicodedata.category(c)
    return kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or 0xFE00 <= ord(c) <= 0xFE0F or c in "͏ᅟᅠㅤﾠ"


def _same(c: str) -> str | None:
    """What the character database says looks like `c`, if anything."""
    if ord(c) in ROMAN:
        return ROMAN[ord(c)]
    d = unicodedata.decomposition(c)
    if not d:
        return None
    tag, _, rest = d.partition(" ")
    if tag in SAME_LOOK or not tag.startswith("<"):
        parts = rest if tag.startswith("<") else d
        return "".join(chr(int(x, 16)) for x in parts.split())
    if tag == "<compat>" and (0x2E80 <= ord(c) <= 0x2FDF or 0xFB00 <= ord(c) <= 0xFB06):
        return "".join(chr(int(x, 16)) for x in rest.split())
    return None


class Classes:
    """Union-find over strings; the representative of a class is its most frequent single character."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def rules(counts: dict[str, int]) -> dict[str, str]:
    """pattern -> representative for the characters of a corpus, from their counts.

    At most one entry a code point and one a (base look-alike, mark look-alike) string, so bounded by the character set.
    """
    classes = Classes()
    marks = {"゙": ["゙", "゙", "ﾞ", "゛"], "゚": ["゚", "ﾟ", "゜"]}
    for mark in counts:
        if unicodedata.combining(mark):
            marks.setdefault(mark, [mark])
    for group in SAME_SHAPE:
        for c in group[1:]:
            classes.join(group[0], c)
    for c in BLANKS[1:]:
        classes.join(" ", c)
    composed: dict[str, set[tuple[str, str]]] = {}
    work, seen = list(counts), set()
    while work:
        c = work.pop()
        if c in seen or invisible(c):
            continue
        seen.add(c)
        full = unicodedata.normalize("NFD", c)
        same = _same(c)
        if same is not None and len(same) == 1:
            classes.join(c, same)
            work.append(same)
        elif same is not None:
            classes.join(c, same)
            if len(same) == 2 and unicodedata.combining(same[1]):
                composed.setdefault(c, set()).add((same[0], same[1]))
                work.append(same[0])
        elif len(full) == 2:
            composed.setdefault(c, set()).add((full[0], full[1]))
    # every base with every mark in the corpus composes, also where only the pieces occur
    for base in list(seen):
        for mark in marks:
            whole = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", base) + mark) if base in seen else ""
            if len(whole) == 1 and whole not in composed:
                full = unicodedata.decomposition(whole).split()
                if len(full) == 2:
                    composed[whole] = {(chr(int(full[0], 16)), chr(int(full[1], 16)))}
                    same = _same(whole)
                    if same:
                        classes.join(whole, same)
    members = {x: g for g in classes.groups() for x in g}
    for whole, pairs in composed.items():
        for base, mark in pairs:
            for b in [x for x in members.get(base, [base]) if len(x) == 1]:
                for m in marks.get(mark, [mark]):
                    classes.join(whole, b + m)
    out = {}
    for group in classes.groups():
        single = [x for x in group if len(x) == 1] or group
        best = min(single, key=lambda x: (-counts.get(x, 0), len(x), x))
        if " " in group:
            best = " "
        if len(single) == 1 and len(group) > 1 and ord(single[0]) in ROMAN:
            best = ROMAN[ord(single[0])]
        out.update({x: best for x in group if x != best})
    out.update({c: "" for c in counts if invisible(c)})
    return out


def automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    """The multi-pattern automaton of a rule table."""
    a = ahocorasick.Automaton()
    for x, y in table.items():
        a.add_word(x, (len(x), y))
    a.make_automaton()
    return a


def rewritten(text: str | None, a: ahocorasick.Automaton) -> str | None:
    """`text` with every leftmost longest pattern replaced until none is left, blanks at the ends off."""
    if text is None:
        return None
    # each round shortens the text, or puts representatives, which are no patterns, for patterns: it comes to an end
    while len(a):
        out, at = [], 0
        for end, (n, y) in a.iter_long(text):
            out.append(text[at : end - n + 1])
            out.append(y)
            at = end + 1
        if not at:
            break
        out.append(text[at:])
        text = "".join(out)
    return text.strip()


def char_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """How often each character occurs in the columns, over all rows; one row a code point reaches the driver."""
    texts = F.explode(F.array(*[F.col(f"`{c}`") for c in columns]))
    chars = df.select(texts.alias("_t")).where("_t is not null").select(F.explode(F.split("_t", "")).alias("_c"))
    return {r[0]: r[1] for r in chars.where("_c <> ''").groupBy("_c").count().collect() if r[0]}


class _Worker:
    """The automaton of one rule table in a worker, found by the table's name."""

    def __init__(self, name: str, table: dict[str, str]):
        self.name, self.table = name, table

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Worker) and self.name == other.name


@lru_cache(maxsize=4)
def _automaton(worker: _Worker) -> ahocorasick.Automaton:
    return automaton(worker.table)


def all_rewritten(texts: pd.Series, a: ahocorasick.Automaton) -> pd.Series:
    """The consistent forms of a batch, as strings even where every one of them is null."""
    known = {t: rewritten(t, a) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) if isinstance(t, str) else None for t in texts], index=texts.index, dtype=object)


def look(column: Column, table: dict[str, str]) -> Column:
    """The consistent form of a string column under a rule table."""
    worker = _Worker(hashlib.sha256(repr(sorted(table.items())).encode("utf-8", "surrogatepass")).hexdigest(), table)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return all_rewritten(s, _automaton(worker))

    return run(column)


def places(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, place, form): every row with what its columns look like together and how they are stored, as JSON arrays.

    Rows of one place look the same; they are stored alike where their forms are equal too. A null looks like nothing
    but null. Distinct stored forms are rewritten once each, whatever the number of rows.
    """
    table = rules(char_counts(df, columns))
    d = df.select(F.col(f"`{key}`").alias("key"), F.to_json(F.array(*[F.col(f"`{c}`") for c in columns])).alias("form"))
    forms = d.select("form").distinct().select("form", F.from_json("form", "array<string>").alias("_f"))
    forms = forms.select("form", F.to_json(F.array(*[look(F.col("_f")[i], table) for i in range(len(columns))])).alias("place"))
    return d.join(forms, "form").select("key", "place", "form")


def same_looking_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b): pairs of keys, a < b, whose columns all look the same though at least one is stored differently.

    Only places stored in more than one form reach the join of pairs; nothing gathers the forms or rows of a place.
    """
    rows = checkpointed(places(df, key, columns))
    odd = rows.groupBy("place").agg((F.min("form") != F.max("form")).alias("_odd")).where("_odd").select("place")
    rows = rows.join(odd, "place", "left_semi")
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.place") == F.col("y.place")) & (F.col("x.form") != F.col("y.form")) & (F.col("x.key") < F.col("y.key"))
    return x.join(y, on).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
