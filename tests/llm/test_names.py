from corpusloom.llm import names as N

A = "slug string, display_name string, display_variants array<string>, kansou_slug string, slug_status string"
AUTHORS = [
    ("aobashi_yuzuki", "青橋柚希", ["青橋柚希"], "aobashi_yuzuki", "confirmed"),
    ("nishihata_anno", "西畑杏乃", None, None, "confirmed"),
    ("kitamura_koikichi", "北村恋吉", [None], "shared", "confirmed"),
    ("luxnoshaly", "Luxnoshaly", ["ルクスノシャリィ"], "shared", "confirmed"),
    ("yuzu002", "Aobashi Yuzuki", ["柚希 青橋"], None, "candidate"),
    ("Nishihata_Anno", "にしはた杏乃", None, None, "auto"),
    ("kitamura-koikichi", "北村戀吉", None, "shared", "candidate"),
    ("luxn004", "Luxnoshaly♪", None, None, "candidate"),
    ("aoby0001", "青柚", ["柚希"], None, "auto"),
    ("own_board", "？？？？", None, "aobashi_yuzuki", "auto"),
    ("guest000", "匿名希望", ["ゲスト"], None, "auto"),
    ("guest001", "匿名希望", None, None, "auto"),
    (None, "青橋柚希", None, None, "confirmed"),
    (" ", None, None, None, None),
    ("aobashi_yuzuki", "青橋柚希", ["青橋柚希"], "aobashi_yuzuki", "confirmed"),
]
WORKS = [("aobashi_yuzki", None), ("anno-nishihata", "西畑杏乃"), ("kitamura_koikiti", None), ("shitai_rinhiko", "下井凛彦"), ("shitai-rinhiko", None), ("luxnoshaly_x", None), ("guest00x1", "ゲスト"), (None, "x"), ("aobashi_yuzuki", None)]
WANT = [
    {"aobashi_yuzuki", "yuzu002", "aobashi_yuzki", "aoby0001", "own_board"}, {"nishihata_anno", "Nishihata_Anno", "anno-nishihata"},
    {"kitamura_koikichi", "kitamura-koikichi", "kitamura_koikiti"}, {"luxnoshaly", "luxn004", "luxnoshaly_x"}, {"shitai_rinhiko", "shitai-rinhiko"},
]


def test_pairs(spark):
    a, w = spark.createDataFrame(AUTHORS, A), spark.createDataFrame(WORKS, "author_slug string, credit string")
    got = [tuple(r) for r in N.pairs(a, w).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for g in WANT for x in g for y in g if x < y}


def test_empty(spark):
    a, w = spark.createDataFrame([], A), spark.createDataFrame([], "author_slug string, credit string")
    assert N.pairs(a, w).count() == 0


def test_keys():
    assert N.latin("Sotodoh") == N.latin("sotodou") == N.latin("SOTODOU") and N.latin("Sizumaru") == N.latin("Shizumaru")
    assert N.name_keys("名無しさん") == [] and N.name_keys("？？？？") == [] and N.is_nobody("guest0012")
    assert ("mixed", "m:nisihata|杏乃") in N.name_keys("にしはた杏乃") and ("name", "h:北村恋吉") in N.name_keys("北村戀吉（きたむら）")
    assert N.slug_parts("umain_m0012") == (["umain", "m"], "0012") and N.code_fits("akaa", "akase_anmon") and not N.code_fits("akab", "akase_anmon")
    assert N.name_keys("") == [] and N.name_keys("x" * 100_000)


def test_nothing_within_the_bound_is_lost(spark):
    near = {("kurosawa", "kursoawa"): 1, ("kano", "kanno"): 1, ("kitamura", "kitammuura"): 2, ("aobashiyuzuki", "aobahsiyuuzuki"): 2, ("nishihata", "insihihata"): 2}
    far = [("kano", "kona"), ("kurosawa", "kursoaaw")]
    pairs = [*near, *far]
    typed, known = (spark.createDataFrame([(p[i],) for p in pairs], "key string") for i in (1, 0))
    got = {(r["b"], r["a"]): r["d"] for r in N.near(typed, known).collect()}
    assert got == near
    # every key one or two edits off meets the known one, either way round
    import random

    draw = random.Random(5)
    for _ in range(3000):
        a = b = "".join(draw.choice("aiknos") for _ in range(draw.randint(3, 14)))
        for _ in range(draw.randint(1, 2)):
            i = draw.randrange(len(b) + 1)
            b = draw.choice([b[:i] + draw.choice("aiknos") + b[i:], b[:i] + b[i + 1 :], b[:i] + draw.choice("aiknos") + b[i + 1 :], b[:i] + b[i + 1 : i + 2] + b[i : i + 1] + b[i + 2 :]])
        if a != b and b and N.distance(a, b, 2) <= N.bound(max(len(a), len(b))):
            assert set(N.index_keys(a)) & set(N.probe_keys(b)) and set(N.index_keys(b)) & set(N.probe_keys(a)), (a, b)


def test_person_named_like_a_placeholder(spark):
    a = spark.createDataFrame([("nanashima_ken", "七島健", None, None, "confirmed"), ("guest", "七島健", None, None, "confirmed"), ("guest00x1", "七島健", None, None, "auto")], A)
    w = spark.createDataFrame([("nanashima-ken", "七島健")], "author_slug string, credit string")
    assert {tuple(r) for r in N.pairs(a, w).collect()} == {("nanashima-ken", "nanashima_ken")}
