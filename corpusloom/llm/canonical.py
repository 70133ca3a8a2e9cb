"""Freely typed values mapped to the closest entry of a reference list.

Every entry enters a trie by its slug, name, reading, listed variants, the aliases its description names, and readings
spelt in Latin letters both ways. A typed value is brought to one form (width, case, kana, invisible characters), its
brackets, hedges and endings come off step by step, and each step's text is searched with a Levenshtein automaton under
a bound that depends on the entry's length and script. The closest entry wins; a tie between entries is no match.

Defined results: null or blank values give null; a value without an entry within the bound gives `none`; a taxonomy
without entries gives `none` for everything; values of any length are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.automata import Trie
from corpusloom.operators.bounded import checkpointed, measured

# What people put around a typed value, and colloquial words for entries (extra aliases by slug).
HEDGES = ["やや", "一応", "軽めの", "ほぼ", "たぶん", "多分", "おそらく", "ちょっと", "基本"]
ENDINGS = ["など", "ナド", "風", "系", "もの", "物", "モノ", "ネタ", "っぽい話", "っぽい", "ッポイ話", "作品", "話", "メイン", "中心", "要素"]
NOTES = ["予定", "長編", "短編", "中編", "仮", "再", "済"]
EXTRA = {
    "cat": ["にゃんこ", "ねこ"], "medicine": ["くすり"], "machine": ["メカ"], "computer": ["VR"], "short-short": ["一頁もの", "1頁もの"],
    "legacy": ["旧lib"], "teahouse": ["茶店"], "romance": ["love story"], "mystery": ["探偵もの"], "horror": ["怪奇"], "workplace": ["office"],
    "history": ["史劇"], "theatre": ["playhouse"], "timeslip": ["time travel"], "suspense": ["スリラー"], "fantasy": ["異世界もの", "異世界"],
}
#: Largest reference list, or shard of one, that is held in a worker.
LIST_ROWS = 200_000

_KANA = {
    "きゃ": "kya", "きゅ": "kyu", "きょ": "kyo", "しゃ": "sha", "しゅ": "shu", "しょ": "sho", "ちゃ": "cha", "ちゅ": "chu", "ちょ": "cho",
    "にゃ": "nya", "にゅ": "nyu", "にょ": "nyo", "ひゃ": "hya", "ひゅ": "hyu", "ひょ": "hyo", "みゃ": "mya", "みゅ": "myu", "みょ": "myo",
    "りゃ": "rya", "りゅ": "ryu", "りょ": "ryo", "ぎゃ": "gya", "ぎゅ": "gyu", "ぎょ": "gyo", "じゃ": "ja", "じゅ": "ju", "じょ": "jo",
    "びゃ": "bya", "びゅ": "byu", "びょ": "byo", "ぴゃ": "pya", "ぴゅ": "pyu", "ぴょ": "pyo",
}
_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
for _c, _row in _ROWS.items():
    for _k, _v in zip(_row, "aiueo"):
        _KANA[_k] = _c + _v
_KANA |= {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n"}
_FOREIGN = {"ふぁ": "fa", "ふぃ": "fi", "ふぇ": "fe", "ふぉ": "fo", "てぃ": "ti", "でぃ": "di", "うぃ": "wi", "うぇ": "we", "ゔ": "vu", "しぇ": "she", "じぇ": "je", "ちぇ": "che"}
_KUNREI = [("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("fu", "hu"), ("ji", "zi"), ("sh", "sy"), ("ch", "ty"), ("j", "zy")]


def hiragana(text: str) -> str:
    """Katakana as hiragana."""
    return "".join(chr(ord(c) - 96) if "ァ" <= c <= "ヶ" else c for c in text)


def romaji(reading: str, foreign: bool = True) -> str:
    """A kana reading in Latin letters; small vowels without a known combination stay as they are."""
    s, out, i = hiragana(reading), "", 0
    double = False
    while i < len(s):
        two, one = s[i : i + 2], s[i]
        if one == "っ":
            double, i = True, i + 1
            continue
        if one == "ー" and out and out[-1] in "aiueo":
            out, i = out + out[-1], i + 1
            continue
        if foreign and two in _FOREIGN:
            x, i = _FOREIGN[two], i + 2
        elif two in _KANA and len(two) == 2:
            x, i = _KANA[two], i + 2
        else:
            x, i = _KANA.get(one, one), i + 1
        if double and x and x[0].isascii():
            x = ("t" if x.startswith("ch") else x[0]) + x
        double = False
        out += x
    return out


def kunrei(hepburn: str) -> str:
    """The other common Latin spelling of a reading."""
    for a, b in _KUNREI:
        hepburn = hepburn.replace(a, b)
    return hepburn


_JOINTS = re.compile(r"[\s\-‐‑–—―−_・･·.'’]+")


def folded(text: str) -> str:
    """One form of a value: compatibility width, lower case, hiragana, no invisible characters, blanks or joints."""
    s = unicodedata.normalize("NFKC", text)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n")
    s = hiragana(s.lower())
    # dashes between kana are length marks
    s = re.sub(r"(?<=[ぁ-ゖー])[\-‐‑–—―−]", "ー", s)
    return _JOINTS.sub("", s)


_OPEN, _CLOSE = "「『【［[(（〈《\"'“", "」』】］])）〉》\"'”"
_EDGE = "※#→・*?？!！。、,.…〜~♪☆★◆◇■□●○:;"
_NOTE = re.compile(r"[(（](?:[?？]+|" + "|".join(NOTES) + r")[)）]$")
_PART = re.compile(r"[・·]?\s*その[\s・]*[0-9一二三四五六七八九十]+$")
_NUMBER = re.compile(r"^\s*\d{1,2}[.)、]\s*")
_ENDINGS = sorted({hiragana(e) for e in ENDINGS}, key=len, reverse=True)


#: Values longer than this lose repeated trimmings of one kind at once, shorter ones one at a time.
LONG = 400


def _trimmings():
    """Functions that each take one kind of trimming off a text, or give it back as it is."""
    yield lambda x: x.strip().strip(_EDGE).strip()
    yield lambda x: x[1:-1].strip() if len(x) > 1 and x[0] in _OPEN and x[-1] in _CLOSE else x
    yield lambda x: x[1:].strip() if x and x[0] in _OPEN and x[-1] not in _CLOSE else x
    yield lambda x: x[:-1].strip() if x and x[-1] in _CLOSE and x[0] not in _OPEN and not any(c in x for c in "(（") else x
    for pattern in (_NOTE, _PART, _NUMBER):
        yield lambda x, p=pattern: p.sub("", x).strip()
    solid = lambda x: re.sub(r"[\s・]", "", x)
    for pattern in (_NOTE, _PART):
        yield lambda x, p=pattern: y if (y := p.sub("", s := solid(x))) != s else x
    for h in HEDGES:
        yield lambda x, h=h: s[len(h) :] if (s := solid(x)).startswith(h) else x
    for e in _ENDINGS:
        yield lambda x, e=e: s[: -len(e)] if (s := solid(x)).endswith(e) and len(s) > len(e) else x


_TRIMMINGS = list(_trimmings())


def stripped(text: str) -> list[str]:
    """The value and what is left of it as its trimmings come off, one at a time, in folded form.

    Each step shortens the text and no text is taken up twice, so the steps come to an end by themselves.
    """
    s = hiragana(unicodedata.normalize("NFKC", text))
    s = "".join(c for c in s if unicodedata.category(c) != "Cf").strip()
    out, todo = dict.fromkeys([s] if s else []), deque([s] if s else [])
    while todo:
        x = todo.popleft()
        for trim in _TRIMMINGS:
            y = trim(x)
            while len(y) > LONG and (z := trim(y)) != y:
                y = z
            if y and y not in out:
                out[y] = None
                todo.append(y)
    return list(dict.fromkeys(f for f in map(folded, out) if f))


def bound(entry: str) -> int:
    """Edits allowed for an entry in folded form, by length and script."""
    n = len(entry)
    if entry.isascii():
        return 0 if n <= 3 else 1 if n <= 8 else 2
    if re.fullmatch(r"[ぁ-ゖー]+", entry):
        return 0 if n <= 2 else 1 if n <= 8 else 2
    return 0 if n <= 2 else 1 if n <= 8 else 2


@lru_cache(maxsize=None)
def reach(n: int) -> int:
    """Most edits that any entry allows to a typed text of n characters: an entry may be longer by as many."""
    return max(k for k in range(3) if bound("あ" * (n + k)) >= k)


def _plausible(entry: str, typed: str, distance: int) -> bool:
    """In short entries with ideographs an ideograph for another is another word, and a lost one is, too."""
    if distance == 0 or entry.isascii():
        return True
    han = lambda s: [c for c in s if "一" <= c <= "鿿"]
    if len(entry) <= 4 and han(entry):
        new = [c for c in typed if c not in entry]
        return len(typed) >= min(len(entry), 3) and all(not ("一" <= c <= "鿿") for c in new) and (len(typed) >= len(entry) or len(entry) == 4)
    if len(entry) <= 3:
        return sorted(entry) == sorted(typed) or len(typed) > len(entry) or typed == entry.replace("ー", "")
    return True


_TAIL = re.compile(r"(に分類されるもの|を扱う話|の作品|とも)$")


def aliases(slug: str, name: str, reading: str | None, variants, description: str | None) -> list[str]:
    """Every written form of an entry, unfolded."""
    out = [slug, name, *(variants if variants is not None else []), *EXTRA.get(slug, [])]
    if reading:
        out += [reading, romaji(reading), romaji(reading, False), kunrei(romaji(reading)), kunrei(romaji(reading, False))]
    if description:
        text = _TAIL.sub("", description.strip("。").strip())
        text = text[1:-1] if text.startswith("「") and text.endswith("」") else text
        out += [x.strip("「」 ") for x in text.split("・")]
    out += [x.replace("ー", "") for x in out if len(x) >= 6 and x.count("ー") > 1]
    return [x for x in out if x]


@lru_cache(maxsize=4)
def _tries(rows: tuple) -> dict[str, Trie]:
    """A trie for each taxonomy."""
    out: dict[str, Trie] = {}
    for taxonomy, slug, name, reading, variants, description in rows:
        trie = out.setdefault(taxonomy, Trie())
        for a in aliases(slug, name, reading, variants, description):
            if folded(a):
                trie.add(folded(a), slug)
    return out


def nearest(value: str, trie: Trie) -> tuple[tuple[int, int], set[str]] | None:
    """((edits, trimmings taken off), slugs) of the entries nearest to a typed value; an exact one ends the search."""
    best: tuple[int, int] | None = None
    slugs: set[str] = set()
    for step, text in enumerate(stripped(value)):
        exact = trie.exact(text)
        if exact:
            return (0, step), set(exact)
        for entry, slug, d in trie.within(text, reach(len(text))):
            if d > bound(entry) or not _plausible(entry, text, d):
                continue
            rank = (d, step)
            if best is None or rank < best:
                best, slugs = rank, {slug}
            elif rank == best:
                slugs.add(slug)
    return None if best is None else (best, slugs)


def closest(value: str | None, trie: Trie | None) -> str | None:
    """The slug meant by a typed value, `none` without one, null for null and blank values."""
    if value is None or not value.strip():
        return None
    found = nearest(value, trie) if trie is not None else None
    return found[1].pop() if found and len(found[1]) == 1 else "none"


def _held(rows) -> tuple:
    return tuple(sorted((r["taxonomy"], r["slug"], r["name"] or "", r["yomi"], tuple(x for x in (r["lookup_variants"] if r["lookup_variants"] is not None else ()) if x), r["description"]) for r in rows if r["taxonomy"] and r["slug"]))


def mapped(vocabulary: DataFrame, values: DataFrame) -> DataFrame:
    """(taxonomy, raw, slug) for the distinct values(taxonomy, raw).

    A reference list of up to LIST_ROWS rows goes to every worker; a larger one is dealt into shards (see `sharded`).
    """
    listed = vocabulary.select("taxonomy", "slug", "name", "yomi", "lookup_variants", "description").distinct()
    rows = listed.limit(LIST_ROWS + 1).collect()
    if len(rows) > LIST_ROWS:
        return sharded(listed, values)
    held = _held(rows)

    @F.pandas_udf("string")
    def run(taxonomies: pd.Series, values: pd.Series) -> pd.Series:
        tries = _tries(held)
        return pd.Series([closest(v, tries.get(t)) for t, v in zip(taxonomies, values)], dtype=object)

    return values.select("taxonomy", "raw", run("taxonomy", "raw").alias("slug"))


def sharded(listed: DataFrame, values: DataFrame) -> DataFrame:
    """The same for a reference list of any size: shards of it, each a trie, meet the values of their taxonomy in blocks.

    Every shard gives its nearest entries with their rank; the best rank over all shards decides, so the result is the
    one that a single trie would give.
    """
    shards = -(-listed.count() // LIST_ROWS)
    blocks = -(-values.count() // LIST_ROWS)
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(max(n, 1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    entries = listed.where("taxonomy is not null and slug is not null").withColumn("_shard", deal(shards, "slug")).withColumn("_block", each(blocks))
    asked = values.select("taxonomy", "raw").withColumn("_block", deal(blocks, "raw")).withColumn("_shard", each(shards))
    by = ["taxonomy", "_shard", "_block"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            trie = next(iter(_tries(_held(left.to_dict("records"))).values()))
            for t, raw in zip(right["taxonomy"], right["raw"]):
                found = nearest(raw, trie) if isinstance(raw, str) and raw.strip() else None
                out += [(t, raw, *found[0], slug) for slug in found[1]] if found else []
        return pd.DataFrame(out, columns=["taxonomy", "raw", "edits", "step", "slug"])

    hits = entries.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "taxonomy string, raw string, edits int, step int, slug string")
    ranked = hits.groupBy("taxonomy", "raw", "edits", "step").agg(F.min("slug").alias("lo"), F.max("slug").alias("hi"))
    best = ranked.groupBy("taxonomy", "raw").agg(F.min(F.struct("edits", "step", "lo", "hi")).alias("b"))
    both = values.select("taxonomy", "raw").join(best, ["taxonomy", "raw"], "left")
    blank = F.col("raw").isNull() | ~F.col("raw").rlike(r"(?U)\S")
    return both.select("taxonomy", "raw", F.when(~blank, F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).otherwise("none")).alias("slug"))


def typed_values(terms: DataFrame, episodes: DataFrame) -> DataFrame:
    """(field, row_no, taxonomy, raw): each distinct non-blank value of a row of terms and episodes."""
    listed = terms.select(F.lit("raw_variants").alias("field"), F.col("term_no").alias("row_no"), "taxonomy", F.explode(F.array_distinct("raw_variants")).alias("raw"))
    single = episodes.select(F.lit("corpus").alias("field"), F.col("entry_no").alias("row_no"), F.lit("ts_corpus").alias("taxonomy"), F.col("corpus").alias("raw"))
    return listed.unionByName(single).where(F.col("raw").rlike(r"(?U)\S")).distinct()


def found(terms: DataFrame, episodes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field, row_no, raw, slug) of every typed value that is not exactly a slug or name of its taxonomy.

    Each distinct value is mapped once and joined back to its rows.
    """
    exact = measured(vocabulary.select("taxonomy", F.explode(F.array("slug", "name")).alias("raw")).where("raw is not null").distinct())
    typed = typed_values(terms, episodes).join(exact, ["taxonomy", "raw"], "left_anti")
    # one kind of value a row, so a value that many rows hold is one row here; dealt out for the work in Python
    spark = terms.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = checkpointed(mapped(vocabulary, typed.select("taxonomy", "raw").repartition(parts, "taxonomy", "raw").distinct()))
    return typed.join(values, typed["taxonomy"].eqNullSafe(values["taxonomy"]) & (typed["raw"] == values["raw"])).select("field", "row_no", typed["raw"], "slug")
