import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bodies as B
from corpusloom.operators import listings as L
from corpusloom.operators import records as R


def made(spark, f, *rows):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{n} string" for n in range(len(rows[0]))))
    return [r["x"] for r in d.select("i", f(*[F.col(f"c{n}") for n in range(len(rows[0]))]).alias("x")).orderBy("i").collect()]


def test_chrome(spark):
    nav = '<a href="i.html">戻る</a>'
    got = made(spark, B.stripped, f"{nav}<hr>題名 作者<HR><p>本文です。</p><hr>{nav}", "<p>本文だけ</p>", "a<hr>b", "", None, f"<p>文。</p><hr>{nav}<hr><p>文。</p>")
    assert [tuple(x) for x in got] == [("<p>本文です。</p><hr>", f"{nav}<hr>題名 作者<HR>", nav), ("<p>本文だけ</p>", "", ""), ("a<hr>b", "", ""), ("", "", ""), (None, None, None), (f"<p>文。</p><hr>{nav}<hr><p>文。</p>", "", "")]
    assert made(spark, B.is_chrome, "<a>戻る</a> | TOP", "これは本文です。", "戻る" * 101) == [True, False, False]


def test_nav_lines(spark):
    got = made(spark, B.trimmed, "\n戻る\n本文\n----\n次へ\n", "戻る\nTOP", "本文\n戻る\n本文", None)
    assert [tuple(map(lambda v: v, x)) for x in got] == [("本文\n", ["戻る"], ["次へ"]), ("", ["戻る", "TOP"], []), ("本文\n戻る\n本文\n", [], []), (None, None, None)]


def test_tables_and_wraps(spark):
    assert made(spark, B.table_kind, "<table>" + "<td>a</td>" * 6 + "</table>", "<table><td>" + "長" * 30 + "</td></table>", "<table></table>") == ["data", "layout", "layout"]
    assert made(spark, B.reflowed, "あいう\nえお。\n\n「か」\nき", "a\nb\nc", None) == ["あいうえお。\n\n「か」\nき", "abc", None]


def test_markdown(spark):
    got = made(spark, B.to_markdown, '<p>あ<ruby>漢<rt>かん</rt></ruby></p><hr><blockquote>引用\n二</blockquote><h2>見出し</h2><img src="a.gif"> &lt;x&gt;', "<p> </p>", None, "\n".join(["これは物理的に折り返された文章の一行目であり続きがまだまだある"] * 31))
    assert tuple(got[0]) == ('あ<ruby>漢<rt>かん</rt></ruby>\n\n----\n\n> 引用\n> 二\n\n## 見出し\n\n<img src="a.gif"> &lt;x&gt;\n', "br-para")
    assert tuple(got[1]) == ("", "empty") and got[3]["mode"] == "hard-wrapped" and got[3]["md"].count("\n") == 1
    assert [(b["kind"], b["text"]) for b in made(spark, B.blocks, "一\n\n----\n\n## 見\n\n> a\n> b\n\n![題](p.gif)\n")[0]] == [("paragraph", "一"), ("rule", ""), ("heading", "見"), ("quote", "a\nb"), ("image", "![題](p.gif)")]
    assert made(spark, B.image_warnings, '![a](http://x/y.gif) <img src="b.gif">')[0] == ["http://x/y.gif"]


def test_parts(spark):
    assert tuple(made(spark, B.part_at, ('<a name="p1">一</a><a name=p2>二', "#P2"))[0]) == ("<a name=p2>二", True)


def test_rechecks(spark):
    rows = [('<body><a href="i">戻る</a><p>本文です。</p></body>', "本文です。\n"), ("<body><p>本文です。</p></body>", "違う本文です。\n"), ("<body><p>前置きの地の文。</p><p>本文です。</p></body>", "本文です。\n"), ("<a>戻る</a>", "----\n"), ("<p>地の文です。</p>", ""), ("x", None)]
    got = [tuple(x) for x in made(spark, B.rechecked, *rows)]
    assert got == [("match", 2, 0), ("mismatch", None, None), ("match-but-chrome-suspect", 8, 0), ("match-empty", None, None), ("empty-md-suspect", None, None), ("no-md", None, None)]


def test_verdicts(spark):
    rows = [("前置き本文です", "本文です"), ("あ" * 20 + "本文です", "本文です"), ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmXXXXXXXXXXXXXXXXnopqrstuvwxyz"), ("abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijkl0123456789"), ("abc", ""), ("abcdefgh", "hgfedcba"), ("本文…です", "本文...です"), ("a", None)]
    assert made(spark, B.verdict, *rows) == ["ok", "ok-trimmed", "ng-extra", "ng-missing", "ng-missing", "ng-order", "ok-texturize", "error"]


def test_line_diffs_against_brute_force(spark):
    import random

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(3)
    rows = [("\n".join(rnd.choice("abc") for _ in range(rnd.randrange(9))), "\n".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))) for _ in range(60)] + [("", ""), ("x", "x\n")]
    split = lambda s: s.rstrip("\r\n").splitlines() if s else []
    want = []
    for a, b in rows:
        x, y = split(a), split(b)
        c = lcs(x, y)
        want.append((len(x) + len(y) - 2 * c, len(y) - c, len(x) - c))
    assert [tuple(x) for x in made(spark, B.line_diff, *rows)] == want
    assert made(spark, B.line_diff, (None, "a"))[0]["changed"] is None


GOOD = (
    '<TABLE BORDER=1><TR><TD><a href="novel/a.html"><B>題名</B></a></TD><TD><B>たろう さん</B> (<a href="http://hp.example/">Homepage</a>)</TD><TD>画(<B>花子さん</B>)</TD><TD>2001/2/3（土）</TD><TD>12 KB / 2 FILES</TD>'
    '<TD><a href="kansou/taro/">感想</a></TD></TR><TR><TD><B>【あらすじ】</B>あら<a href="b.html">【第2話はこちら】</a></TD></TR><TR><TD><B>【コメント】</B>こめ</TD></TR><TR><TD>【ジャンル】 学園　ＴＳ 【種別】 短編</TD></TR></TABLE>'
)


def test_regular_pages(spark):
    bad = GOOD.replace("<TR><TD><B>【あらすじ】", "<TR><TD>x</TD></TR><TR><TD><B>【あらすじ】")
    d = spark.createDataFrame([("lib1.html", GOOD + bad), ("lib2.html", "nothing"), ("lib3.html", None)], "page string, html string")
    rows = sorted(L.regular(d, "page", "html").collect(), key=lambda r: r["n"])
    assert [r["failure"] for r in rows] == [None, "lib1.html#2: expected 4 rows, got 5"] and rows[1]["entry"] is None
    e = rows[0]["entry"]
    assert (e["title"], e["href"], e["author"], e["homepage"], e["illustrators"], e["date"], e["weekday"], e["size_kb"], e["files_n"], e["kansou_slug"]) == ("題名", "novel/a.html", "たろう", "http://hp.example/", ["花子"], "2001-02-03", "土", 12, 2, "taro")
    assert (e["arasuji"], e["comment"], e["genre"], [x["href"] for x in e["nav_links"]]) == ("あら", "こめ", ["学園", "ＴＳ"], ["b.html"])


def test_recommendations_and_notices(spark):
    r = made(spark, L.recommendations, '<B>【山田さんのオススメ作品】</B> <a href="x1.html">『緋色の風１</a><a href="x2.html">／２』</a>（鈴木さん作）', "なし", None)
    assert r[0]["recommender"] == "山田" and [(x["title"], x["author"], x["inherited"]) for x in r[0]["refs"]] == [("緋色の風１", "鈴木", True), ("／２", "鈴木", False)] and r[1] is None and r[2] is None
    assert tuple(made(spark, L.notice, "前文。作者である太郎さんの要望により公開を停止しました（2002/1/1）")[0]) == ("太郎", "公開を停止", "")


def test_works_merged_split_and_detached(spark):
    w = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")], "work_slug string, author_slug string")
    rules = spark.createDataFrame([("b", "a"), ("c", "a"), ("z", "a"), ("a", "a"), ("d", "b")], "merge string, into string")
    out, bad = R.merged_works(w, rules)
    # b goes into a, but a is named as merged itself by the rule that names it twice
    assert {r["merge"]: r["reason"] for r in bad.collect()} == {"b": "chain", "c": "chain", "z": "missing", "a": "itself", "d": "chain"}
    out, bad = R.merged_works(w, spark.createDataFrame([("b", "a"), ("c", "a")], "merge string, into string"))
    assert {r["work_slug"]: r["work"] for r in out.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"} and [r["reason"] for r in bad.collect()] == ["author"]
    m = spark.createDataFrame([("w", i) for i in range(4)], "work string, member int")
    out, bad = R.regrouped(m, spark.createDataFrame([(1, "t"), (2, "")], "member int, title string"), spark.createDataFrame([(3,), (9,)], "member int"))
    assert {r["member"]: r["work"] for r in out.collect()} == {0: "w", 1: "w/t", 2: "w", 3: "w/=3"} and {r["member"]: r["reason"] for r in bad.collect()} == {2: "no title", 9: "missing"}


@pytest.mark.parametrize("key", ["k", None])
def test_collisions_with_nulls(spark, key):
    d = spark.createDataFrame([(1, key), (2, key), (3, "z")], "i int, p string")
    assert sorted(r["n"] for r in R.collision_suffix(d, ["p"], F.col("i").cast("string"), F.lit("d"), "n").collect()) == ["1+d", "2+d", "3"]


def test_first_few(spark):
    d = spark.createDataFrame([("a", x) for x in "cabd"] + [("b", "z")], "k string, v string")
    assert {r["k"]: (r["n"], r["few"]) for r in R.first_few(d, ["k"], "v", 2).collect()} == {"a": (4, ["a", "b"]), "b": (1, ["z"])}
