"""Variant spellings of personal names and name slugs, linked to one person.

Every slug gets the written forms known for it: itself and its row's names. Forms become keys in one name space: Latin
letters with the spelling systems for Japanese folded together, ideographs with old forms folded, mixed spellings as
reading and ideographs, and weaker ones (one part of a name, initials, first ideographs, nicknames). Latin keys meet
within a bounded edit distance by a pigeonhole join: the known key is cut into k + 1 segments, the typed key's
substrings at the shifted places that k edits allow, also with an exchange at their border undone, are looked up in the
inverted index of segments, and a banded edit distance decides.

Slugs of confirmed records are persons. Another slug joins the person for whom its evidence is strongest, if that is
enough and no other person has as much. Slugs without a person are linked among themselves by equal and close keys.

Defined results: null and blank slugs and slugs or names that stand for nobody in particular give no link; rows that
repeat count once; a slug links to nothing rather than to one of two equally likely persons.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.canonical import hiragana, romaji
from corpusloom.operators.bounded import checkpointed, spread
from corpusloom.operators.graph import components

# Names that stand for nobody, what is put around names, old and variant forms of ideographs.
NOBODY = ["名無し", "名無しさん", "名無しさん@", "匿名希望", "匿名", "ゲスト", "通りすがり", "編集部", "管理人", "不明", "作者不詳", "読者", "anonymous", "guest", "unknown", "nobody", "admin", "no name", "noname", "nanashi"]
TITLES = ["先生", "さん", "様", "氏", "さま", "君", "くん", "殿", "老師", "どの"]
PETS = ["ちゃん", "りん", "っち", "たん", "ぽん", "にゃん", "くん", "さん", "P", "p", "坊", "きゅん"]
FORMS = (
    "戀恋濱浜瀨瀬嶋島嶌島邑村宫宮內内國国澤沢髙高﨑崎櫻桜龍竜惠恵眞真廣広圓円邊辺邉辺齋斎齊斉壽寿德徳曾曽藏蔵莊荘靜静榮栄瀧滝淵渕實実條条乘乗燈灯穗穂鐵鉄圖図豐豊禮礼"
    "來来萬万縣県螢蛍聲声學学氣気鹽塩淺浅舩船峯峰巖岩嵓岩栁柳槇槙桒桑渓谷溪谷谿谷鷗鴎寳宝寶宝藝芸戶戸步歩黑黒綠緑彌弥祿禄郞郎奧奥薰薫亞亜稻稲樂楽峽峡絲糸鍊錬鷄鶏雙双"
    "飜翻舍舎發発變変繪絵續続總総聰聡莖茎藪薮蠶蚕衞衛裝装譽誉讓譲釋釈錢銭關関陷陥隱隠靈霊顯顕飮飲餘余驛駅體体鬪闘點点齡齢龜亀靑青"
)
#: Evidence of each kind; a link needs ENOUGH and a clear lead.
WEIGHTS = {"slug": 10.0, "board": 9.0, "name": 6.0, "near_slug": 6.0, "mixed": 5.0, "near_name": 4.0, "skeleton": 3.0, "weak": 1.0, "code": 1.5}
ENOUGH = 2.5
#: Two edits alone do not make a link.
TWO_EDITS = 2.0

_FOLD = {ord(old): new for old, new in zip(FORMS[::2], FORMS[1::2])}
_NOBODY = {re.sub(r"\W", "", unicodedata.normalize("NFKC", x).lower()) for x in NOBODY}
_HAN = "㐀-鿿々〆豈-﫿"
_KANA = "ぁ-ゖー"


def is_nobody(name: str) -> bool:
    """A name that stands for nobody in particular."""
    s = re.sub(r"[\W_]", "", unicodedata.normalize("NFKC", name).lower())
    return s in _NOBODY or not s or re.sub(r"[0-9]+[a-z]?[0-9]*$", "", s) in _NOBODY


def latin(text: str) -> str:
    """Latin letters with the spelling systems for Japanese folded together."""
    s = unicodedata.normalize("NFKC", text).lower()
    s = re.sub(r"(?<=[a-z])0(?=[a-z])", "o", s)
    s = re.sub(r"(?<=[a-z])1(?=[a-z])", "i", s)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if "a" <= c <= "z")
    s = re.sub(r"oh(?![aeiouy])", "ou", s)
    for a, b in (("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("fu", "hu"), ("ji", "zi"), ("sh", "sy"), ("ch", "ty"), ("j", "zy"), ("ou", "o"), ("oo", "o"), ("uu", "u")):
        s = s.replace(a, b)
    return s


def letters(text: str) -> str:
    """Latin letters as typed: a slip may break a spelling that folding looks for."""
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())
    return "".join(c for c in s if "a" <= c <= "z")


def skeleton(text: str) -> str:
    """Consonants of a foreign name as they survive in kana."""
    s = text
    for a, b in (("kh", "h"), ("th", "t"), ("ph", "h"), ("gh", "g"), ("ck", "k"), ("ci", "si"), ("ce", "se"), ("c", "k"), ("q", "k"), ("l", "r"), ("v", "b"), ("f", "h"), ("x", "kus"), ("w", "u")):
        s = s.replace(a, b)
    s = re.sub(r"[aeiouy]", "", s)
    return re.sub(r"(.)\1+", r"\1", s)


_MARKS = re.compile(r"[♪☆★◆◇■□●○*＊※！!]+")
_PAREN = re.compile(r"[(（\[［【][^)）\]］】]*[)）\]］】]")
_AFTER = re.compile(r"([/／@＠].*|\s+(作|著|文)|\(再\)|（再）)$")


def cleaned(name: str) -> tuple[list[str], bool]:
    """(parts of a name, whether a pet ending came off): width folded, brackets, marks, titles and notes off."""
    s = unicodedata.normalize("NFKC", name)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf").strip()
    s = _MARKS.sub("", _PAREN.sub("", s)).strip()
    s = _AFTER.sub("", s).strip()
    s = s.translate(_FOLD)
    if re.fullmatch(r"(?:[A-Za-z]_)+[A-Za-z]", s):
        s = s.replace("_", "")
    pet = False
    for t in TITLES:
        if s.endswith(t) and len(s) > len(t) + 1:
            s = s[: -len(t)]
    for t in PETS:
        if s.endswith(t) and 1 < len(s) - len(t) <= 5 and re.match(f"^[{_KANA}ァ-ヶ]", s):
            s, pet = s[: -len(t)], True
            break
    parts = [p for p in re.split(r"[\s,、・=＝_/\-‐]+", s) if p]
    return parts, pet


def _kana(s: str) -> bool:
    return re.fullmatch(f"[{_KANA}]+", hiragana(s)) is not None


def _roman(s: str) -> str:
    return latin(romaji(s))


def name_keys(name: str) -> list[tuple[str, str]]:
    """(kind, key) of one written name. Kinds: name, mixed, latin (for the edit-distance join), skeleton, weak."""
    if is_nobody(name):
        return []
    parts, pet = cleaned(name)
    if not parts or is_nobody("".join(parts)):
        return []
    out: list[tuple[str, str]] = []
    whole = "".join(parts)
    orders = [parts] if len(parts) == 1 else [parts, parts[::-1]]
    if re.fullmatch(f"[{_HAN}]+", whole):
        if len(whole) >= 3:
            out += [("name", "h:" + "".join(o)) for o in orders]
            out.append(("weak", "h3:" + whole[:3]))
            if len(whole) == 4 and len(parts) == 1:
                for i in range(4):
                    out.append(("weak", f"h4{i}:" + whole[:i] + "_" + whole[i + 1 :]))
        if len(whole) == 2:
            out += [("weak", "p:" + whole), ("weak", "hh:" + whole)]
    elif re.fullmatch(f"[{_HAN}]+\\.", whole) and len(whole) >= 3:
        out.append(("weak", "h3:" + whole[:-1][:3]))
    elif _kana(whole):
        key = _roman(whole)
        if pet:
            out.append(("weak", "nk:" + key))
        else:
            if len(key) >= 6:
                out += [("latin", _roman("".join(o))) for o in orders]
                out += [("latin", letters(romaji("".join(o)))) for o in orders]
            out += [("weak", "q:" + key), ("skeleton", "s:" + skeleton(key))]
    elif re.search("[A-Za-z]", whole) and not re.search(f"[{_HAN}{_KANA}ァ-ヶ]", whole):
        if len(parts) == 2 and any(re.fullmatch(r"[A-Za-z]\.?", p) for p in parts):
            one, full = sorted(parts, key=len)
            out.append(("weak", f"i:{latin(full)}:{latin(one)[:1]}"))
        elif whole.endswith(".") and len(parts) == 1:
            out.append(("weak", "px:" + latin(whole)[:4]))
        else:
            out += [("latin", f("".join(o))) for o in orders for f in (latin, letters)]
            if len(parts) == 1:
                out += [("weak", "q:" + latin(whole)), ("weak", "px:" + latin(whole)[:4])]
    else:
        # ideographs on one side, kana on the other
        for o in orders:
            m = re.fullmatch(f"([{_HAN}]+)([{_KANA}]+)|([{_KANA}]+)([{_HAN}]+)", hiragana("".join(o)))
            if m:
                out.append(("mixed", f"m:{m.group(1)}|{_roman(m.group(2))}" if m.group(1) else f"m:{_roman(m.group(3))}|{m.group(4)}"))
    return list(dict.fromkeys(k for k in out if len(k[1]) > 3))


def slug_parts(slug: str) -> tuple[list[str], str]:
    """(letter parts of a slug, its number): joints, case and endings off."""
    s = unicodedata.normalize("NFKC", slug).strip()
    digits = "".join(re.findall(r"\d{3,}", s))
    if not digits:
        s = re.sub(r"[_\-.][a-zA-Z]$", "", s)
    parts = [letters(p) for p in re.split(r"[\W_]+", s)]
    return [p for p in parts if p], digits


def _both_ways(parts: list[str]) -> list[tuple[str, str]]:
    whole = ["".join(parts), "".join(parts[::-1])]
    return [("slug", f(o)) for o in dict.fromkeys(whole) for f in (latin, letters)]


def slug_keys(slug: str) -> list[tuple[str, str]]:
    """(kind, key) of a slug: its letters in both orders; of one that ends in a number, the start of its letters."""
    parts, digits = slug_parts(slug)
    if not parts or is_nobody(slug):
        return []
    return [("code", "_".join(parts))] if digits else list(dict.fromkeys(_both_ways(parts)))


def code_fits(code: str, person: str) -> bool:
    """Whether a slug's letters before a number may come from a person's slug: the start of a part, a start and an initial, or both."""
    parts, own = code.split("_"), slug_parts(person)[0]
    if len(parts) == 2:
        return any(a == parts[0] and b.startswith(parts[1]) for a, b in (own, own[::-1])) if len(own) == 2 else False
    c = parts[0]
    return any(p.startswith(c) for p in own) or (len(own) == 2 and len(c) > 2 and any(a.startswith(c[:-1]) and b[0] == c[-1] for a, b in (own, own[::-1])))


def person_keys(slug: str, names: list[str]) -> list[tuple[str, str]]:
    """Keys under which a person with a confirmed slug is found. Weak ones carry the first letters of a part of the slug."""
    own, digits = slug_parts(slug)
    out = [] if digits else _both_ways(own)
    of_names = [kv for n in names for kv in name_keys(n)]
    out += [(k, v) for k, v in of_names if k in ("name", "mixed", "latin")]
    weak = [v for k, v in of_names if k == "weak" and v.startswith(("nk:", "h3:"))]
    solid = [re.sub(r"[\s_=＝・]", "", "".join(cleaned(n)[0])) for n in names if not is_nobody(n)]
    two = len(own) == 2
    folded = [latin(p) for p in own]
    if two:
        s, g = folded
        weak += [f"i:{s}:{g[:1]}", f"i:{g}:{s[:1]}", "q:" + s, "q:" + g]
        weak += ["nk:" + g[:n] for n in range(2, len(g) + 1)]
    elif own:
        one = "".join(folded)
        weak += ["px:" + one[:4], *("nk:" + one[:n] for n in range(3, 7))]
        out.append(("skeleton", "s:" + skeleton("".join(own))))
    for n in solid:
        if re.fullmatch(f"[{_HAN}]{{3,6}}", n):
            weak.append("h3:" + n[:3])
            if len(n) == 4:
                weak += ["hh:" + n[0] + n[2], "p:" + n[:2], "p:" + n[2:]]
                weak += [f"h4{i}:" + n[:i] + "_" + n[i + 1 :] for i in range(4)]
            if two:
                for i in range(1, len(n)):
                    out += [("mixed", f"m:{folded[0]}|{n[i:]}"), ("mixed", f"m:{n[:i]}|{folded[1]}")]
    out += [("weak", f"{w}|{p[:3]}") for w in dict.fromkeys(weak) for p in own]
    return list(dict.fromkeys(out))


def bound(n: int) -> int:
    """Edits allowed for a key of n letters."""
    return 0 if n < 5 else 1 if n < 9 else 2


def segments(key: str, k: int) -> list[tuple[int, int, str]]:
    """(number, start, text) of the k + 1 even segments of a key."""
    n, out, at = len(key), [], 0
    for i in range(k + 1):
        size = n // (k + 1) + (1 if i >= (k + 1) - n % (k + 1) else 0)
        out.append((i, at, key[at : at + size]))
        at += size
    return out


def reach(n: int) -> int:
    """Most edits between a key of n letters and any other: the longer key sets the bound."""
    return max(k for k in range(3) if bound(n + k) >= k)


def index_keys(key: str) -> list[str]:
    """The inverted index's entries of a known key, for each bound that a pair with it can have."""
    n = len(key)
    return [f"{n}|{k}|{i}|{text}" for k in range(max(1, bound(n)), reach(n) + 1) for i, _, text in segments(key, k)]


def probe_keys(key: str) -> list[str]:
    """What a typed key looks up: for each length within reach, its substrings at the shifted places of each segment.

    Take the edits of each segment, an exchange across a border with the segment on its left. Walking from the left, the
    first segment that makes the edits so far fewer than the segments so far is untouched itself, has exactly as many
    edits as segments before it and so at most k less that many behind it. These two bounds limit where it can stand;
    only its first letter may be exchanged with the one before it, so that substring is looked up, too. No pair within
    k edits is lost.
    """
    out = set()
    for n in range(len(key) - 2, len(key) + 3):
        k, over = bound(max(n, len(key))), len(key) - n
        if not k or abs(over) > k:
            continue
        for i, at, text in segments("?" * n, k):
            size = len(text)
            for shift in range(max(-i, over - (k - i)), min(i, over + (k - i)) + 1):
                start, end = at + shift, at + shift + size
                if start < 0 or end > len(key):
                    continue
                out.add(f"{n}|{k}|{i}|{key[start:end]}")
                if start > 0:
                    out.add(f"{n}|{k}|{i}|{key[start - 1]}{key[start + 1 : end]}")
    return sorted(out)


def distance(a: str, b: str, k: int) -> int:
    """Banded edit distance with exchanges of neighbours as one edit; k + 1 when it is more than k."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    before: list[int] | None = None
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [k + 1] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            d = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != b[j - 1]))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        if min(row) > k:
            return k + 1
        before, above = above, row
    return min(above[-1], k + 1)


_KEYS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType())]))


@F.pandas_udf(_KEYS)
def _typed_keys(slugs: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for s, n in zip(slugs, names):
        keys = slug_keys(s)
        code = next((k[:3] for kind, k in keys if kind == "code"), None)
        for x in n if n is not None else []:
            for kind, key in name_keys(x) if x else []:
                if kind != "weak":
                    keys.append((kind, key))
                elif code:
                    keys.append((kind, f"{key}|{code}"))
        out.append([{"kind": a, "key": b} for a, b in dict.fromkeys(keys)])
    return pd.Series(out, dtype=object)


@F.pandas_udf(_KEYS)
def _person_keys(slugs: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for s, n in zip(slugs, names):
        out.append([{"kind": a, "key": b} for a, b in person_keys(s, [x for x in (n if n is not None else []) if x])])
    return pd.Series(out, dtype=object)


_SEGMENTS = T.StructType([T.StructField("letters", T.LongType()), T.StructField("segments", T.ArrayType(T.StringType()))])


def letter_set(key: str) -> int:
    """The letters of a key as bits; an edit changes two of them at most."""
    out = 0
    for c in key:
        out |= 1 << (ord(c) % 61)
    return out


@F.pandas_udf(_SEGMENTS)
def _index(keys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"letters": keys.map(letter_set).astype("int64"), "segments": keys.map(index_keys)})


@F.pandas_udf(_SEGMENTS)
def _probes(keys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"letters": keys.map(letter_set).astype("int64"), "segments": keys.map(probe_keys)})


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 2) if isinstance(x, str) else 0 for x, y in zip(a, b)], dtype="int32")


def near(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, d): keys of `typed` and `known` within the bound for the longer length, by the pigeonhole segment join.

    Candidates with too many different letters fall out before their distance is counted.
    """
    cut = lambda keys, name, by: keys.select(F.col("key").alias(name)).distinct().withColumn("_s", by(name)).select(name, F.col("_s.letters").alias(f"_{name}"), F.explode("_s.segments").alias("_seg"))
    left, right = cut(typed, "a", _probes), cut(known, "b", _index)
    n = F.greatest(F.length("a"), F.length("b"))
    most = F.when(n < 5, 0).when(n < 9, 1).otherwise(2)
    odd = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b")))
    # an exchange of neighbours is two plain edits that change no letters: what is beyond the bound must be exchanges
    pairs = left.join(right, "_seg").where((F.col("a") != F.col("b")) & (odd <= 2 * most)).withColumn("_d", F.levenshtein("a", "b", 4)).where("_d > 0")
    pairs = pairs.where((F.col("_d") <= most) | (odd <= 2 * (2 * most - F.col("_d")))).select("a", "b", "_d", most.alias("_most")).distinct()
    # one plain edit is the distance itself; the rest may hold exchanges
    far = pairs.withColumn("d", F.when(F.col("_d") > 1, _distance(F.when(F.col("_d") > 1, F.col("a")), F.col("b"))).otherwise(F.col("_d")))
    return far.where(F.col("d") <= F.col("_most")).select("a", "b", "d")


def _people(authors: DataFrame, works: DataFrame) -> DataFrame:
    """One row a slug: (slug, names, board, confirmed)."""
    own = authors.select(
        "slug",
        F.concat(F.array("display_name"), F.coalesce("display_variants", F.array().cast("array<string>"))).alias("names"),
        F.col("kansou_slug").alias("board"),
        (F.coalesce(F.col("slug_status"), F.lit("")) == "confirmed").alias("confirmed"),
    ).distinct()
    typed = works.select(F.col("author_slug").alias("slug"), F.array("credit").alias("names"), F.lit(None).cast("string").alias("board"), F.lit(False).alias("confirmed")).distinct()
    both = own.unionByName(typed.join(own.select("slug").distinct(), "slug", "left_anti"))
    return (
        both.where(F.col("slug").rlike(r"(?U)\S"))
        .groupBy("slug")
        .agg(F.array_compact(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"), F.max("board").alias("board"), F.max("confirmed").alias("confirmed"))
    )


def links(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(slug, person): every slug that stands for somebody with the slug that stands for the person."""
    people = spread(checkpointed(_people(authors, works)))
    sure = people.where("confirmed")
    open_ = people.where("not confirmed")
    typed = checkpointed(open_.select("slug", F.explode(_typed_keys("slug", "names")).alias("_k")).select("slug", "_k.kind", "_k.key"))
    known = checkpointed(sure.select(F.col("slug").alias("person"), F.explode(_person_keys("slug", "names")).alias("_k")).select("person", "_k.kind", "_k.key"))
    weight = lambda k: F.lit(WEIGHTS[k]).alias("w")
    equal = typed.join(known, ["kind", "key"])
    slug_or_name = F.col("kind").isin("slug", "latin")
    t, k = typed.where(slug_or_name), known.where(slug_or_name)
    same_letters = t.alias("t").join(k.alias("k"), F.col("t.key") == F.col("k.key")).select("slug", "person", F.when((F.col("t.kind") == "slug") & (F.col("k.kind") == "slug"), "slug").otherwise("name").alias("kind"))
    close = near(t, k)
    close = (
        t.alias("t").join(close.alias("c"), F.col("t.key") == F.col("c.a")).join(k.alias("k"), F.col("k.key") == F.col("c.b"))
        .select("slug", "person", F.when((F.col("t.kind") == "slug") & (F.col("k.kind") == "slug"), "near_slug").otherwise("near_name").alias("kind"), "d")
    )
    shared = people.where("board is not null").groupBy("board").agg(F.count_if(F.col("confirmed")).alias("n")).where("n > 1").select("board")
    boards = (
        open_.where("board is not null").join(shared, "board", "left_anti")
        .join(sure.select(F.col("slug").alias("person"), F.col("board").alias("board")).where("board is not null"), "board")
        .select("slug", "person", F.lit("board").alias("kind"))
    )
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    strong = (
        same_letters.unionByName(boards).unionByName(equal.where("kind in ('name', 'mixed', 'skeleton')").select("slug", "person", "kind"))
        .select("slug", "person", "kind", F.lit(None).cast("string").alias("key"), table[F.col("kind")].alias("w"))
        .unionByName(close.select("slug", "person", F.when(F.col("d") > 1, "two").otherwise(F.col("kind")).alias("kind"), F.lit(None).cast("string").alias("key"), F.when(F.col("d") > 1, TWO_EDITS).otherwise(table[F.col("kind")]).alias("w")))
    )
    weak = equal.where("kind = 'weak'").select("slug", "person", "kind", "key", weight("weak"))
    # the same evidence counts once, however often it was met
    best = strong.unionByName(weak).groupBy("slug", "person", "kind", "key").agg(F.max("w").alias("w")).groupBy("slug", "person").agg(F.sum("w").alias("w"))
    code = typed.where("kind = 'code'").select("slug", F.col("key").alias("code"))
    best = best.join(code, "slug", "left")
    best = best.withColumn("w", F.col("w") + F.when(F.col("code").isNull(), 0.0).when(_fits("code", "person"), WEIGHTS["code"]).otherwise(-1.0))
    # the first and the last of the persons with the most evidence are the same one if there is no tie
    top = best.groupBy("slug").agg(F.max(F.struct("w", "person")).alias("_last"), F.min(F.struct(-F.col("w"), "person")).alias("_first"))
    joined = top.where((F.col("_last.w") >= ENOUGH) & (F.col("_last.person") == F.col("_first.person"))).select("slug", F.col("_last.person").alias("person"))
    linked = checkpointed(joined)
    rest = checkpointed(open_.join(linked, "slug", "left_anti").select("slug", "names"))
    return linked.unionByName(sure.select("slug", F.col("slug").alias("person"))).unionByName(_among_themselves(rest, typed))


@F.pandas_udf(T.BooleanType())
def _fits(codes: pd.Series, people: pd.Series) -> pd.Series:
    return pd.Series([c is not None and code_fits(c, p) for c, p in zip(codes, people)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _is_nobody(names: pd.Series) -> pd.Series:
    return names.map(is_nobody).astype(bool)


def _among_themselves(rest: DataFrame, typed: DataFrame) -> DataFrame:
    """(slug, person) of slugs without a confirmed person: connected by equal or close letters or equal full names."""
    keys = typed.join(rest.select("slug"), "slug", "left_semi").where("kind in ('slug', 'name', 'latin')")
    keys = checkpointed(keys.select("slug", "key").distinct())
    close = near(keys, keys).where("d <= 1 and length(a) >= 8").select("a", "b")
    # slugs meet at their keys; close keys are joined to each other
    edges = keys.select(F.concat(F.lit("s:"), "slug").alias("x"), F.concat(F.lit("k:"), "key").alias("y")).unionByName(close.select(F.concat(F.lit("k:"), "a").alias("x"), F.concat(F.lit("k:"), "b").alias("y")))
    labels = components(edges)
    return labels.where("node like 's:%'").select(F.substring("node", 3, 1_000_000).alias("slug"), F.concat(F.lit("?"), "label").alias("person"))


def persons(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(slug, person): one row for each slug that stands for somebody; slugs of one person are linked, pairs need not be written out."""
    return checkpointed(links(authors, works).where(~_is_nobody("slug")))


def pairs(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(slug_a, slug_b): each two different slugs of one person, slug_a < slug_b in code point order."""
    who = persons(authors, works)
    x, y = who.alias("x"), who.alias("y")
    return x.join(y, (F.col("x.person") == F.col("y.person")) & (F.col("x.slug") < F.col("y.slug"))).select(F.col("x.slug").alias("slug_a"), F.col("y.slug").alias("slug_b"))
