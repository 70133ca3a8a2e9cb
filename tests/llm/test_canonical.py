from pyspark.sql import functions as F

from corpusloom.llm import canonical as C

VOCAB = [
    ("g", "fantasy", "ファンタジー", "ふぁんたじー", ["幻想"], "ファンタジー・fantasy・剣と魔法を扱う話。"),
    ("g", "comedy", "コメディ", "こめでぃ", ["喜劇", "お笑い"], "コメディ・comedy・笑える話を扱う話。"),
    ("g", "essay", "エッセイ", "えっせい", None, "「エッセイ・essay・身辺雑記」とも。"),
    ("k", "clock", "時計塔", "とけいとう", ["からくり時計"], None),
    ("k", "cat", "飼い猫", "かいねこ", ["猫"], None),
    ("k", "bat", "蝙蝠", "こうもり", [None], None),
]
SCHEMA = "taxonomy string, slug string, name string, yomi string, lookup_variants array<string>, description string"


def slug(value, taxonomy="g"):
    tries = C._tries(tuple((t, s, n, y, tuple(x for x in v or () if x), d) for t, s, n, y, v, d in VOCAB))
    return C.closest(value, tries.get(taxonomy))


def test_forms():
    assert {v: slug(v) for v in ("ﾌｧﾝﾀｼﾞｰ", "ＦＡＮＴＡＳＹ", "fantazy", "ファンタジ", "剣と魔法", "「幻想」（予定）", "ややファンタジーっぽい話", "fuぁntajii", "f・antasy", "huぁntazii")} == dict.fromkeys(
        ("ﾌｧﾝﾀｼﾞｰ", "ＦＡＮＴＡＳＹ", "fantazy", "ファンタジ", "剣と魔法", "「幻想」（予定）", "ややファンタジーっぽい話", "fuぁntajii", "f・antasy", "huぁntazii"), "fantasy"
    )
    assert slug("esseii") == slug("身辺雑記など") == "essay" and slug("お笑い・その２") == "comedy"


def test_no_entry():
    assert [slug(v) for v in ("将棋", "その他", "？", "xxx")] == ["none"] * 4
    assert slug("時計草", "k") == "none" and slug("時計々", "k") in ("clock", "none")
    assert slug("rat", "k") == "none" and slug("x", "unknown") == "none"
    assert slug(None) is None and slug(" 　") is None and slug("x" * 50_000) == "none"


def test_entry_longer_than_the_value():
    tries = C._tries((("g", "horror", "ホラー", "ほらー", (), None), ("g", "essay", "エッセイ", "えっせい", (), None)))
    assert [C.closest(v, tries["g"]) for v in ("ホラ", "ホラもの", "ホラ系", "ホロ", "ホ")] == ["horror"] * 3 + ["none"] * 2
    # the search reaches whatever bound() allows, and no farther
    for n in range(1, 30):
        assert C.reach(n) == max(C.bound("あ" * m) for m in range(1, 40) if abs(m - n) <= C.bound("あ" * m) or m == n)


def test_rows(spark):
    vocab = spark.createDataFrame(VOCAB, SCHEMA)
    terms = spark.createDataFrame([(1, "g", ["fantazy", None, " ", "comedy", "コメディ", "fantazy"], "x"), (2, "g", None, "x"), (3, None, ["a"], "x")], "term_no long, taxonomy string, raw_variants array<string>, slug string")
    episodes = spark.createDataFrame([(7, "honkan"), (8, None), (9, "")], "entry_no long, corpus string").withColumn("raw", F.lit("clash"))
    got = {tuple(r) for r in C.found(terms, episodes, vocab).collect()}
    assert got == {("raw_variants", 1, "fantazy", "fantasy"), ("raw_variants", 3, "a", "none"), ("corpus", 7, "honkan", "none")}
    assert C.found(terms.where("false"), episodes.where("false"), vocab.where("false")).count() == 0
    assert {r["slug"] for r in C.found(terms, episodes, vocab.where("false")).collect()} == {"none"}


def test_romaji():
    assert C.romaji("きっさてん") == "kissaten" and C.romaji("ショートショート") == "shootoshooto" and C.kunrei("shokuba") == "syokuba" and C.romaji("ふぁんたじー") == "fantajii"


def test_more_trimmings_than_any_cap():
    assert slug("「" * 30 + "幻想" + "」" * 30) == "fantasy" and slug("やや" * 25 + "ファンタジー" + "風系" * 25) == "fantasy"
    for long in ("(" * 20_000 + "幻想", "幻想" + "系" * 20_000, "やや" * 10_000 + "幻想", "1. " * 5_000 + "幻想"):
        assert slug(long) == "fantasy"


def test_a_list_of_any_size_in_shards(spark, monkeypatch):
    vocab = spark.createDataFrame(VOCAB, SCHEMA)
    raws = ["fantazy", "幻想", "猫", "猫もの", "fantas", "comedi", "将棋", "エッセ", "rat", "cat", " ", None, "cta", "時計搭"]
    values = spark.createDataFrame([(t, r) for t in ("g", "k", "z", None) for r in raws], "taxonomy string, raw string")
    whole = {tuple(r) for r in C.mapped(vocab, values).collect()}
    monkeypatch.setattr(C, "LIST_ROWS", 2)
    parts = {tuple(r) for r in C.mapped(vocab, values).collect()}
    assert parts == whole and len(whole) == 4 * len(raws) and ("g", "fantazy", "fantasy") in whole
    assert C.sharded(vocab.where("false"), values.where("false")).count() == 0
