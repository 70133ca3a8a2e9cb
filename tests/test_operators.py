import random

from pyspark.sql import functions as F

from corpusloom.functions import markup, text, urls
from corpusloom.functions.charsets import guess
from corpusloom.operators import graph, links, parsers, records, versions
from corpusloom.operators.bounded import measured


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).collect()[0]["r"]


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(values(graph.components(spark.createDataFrame(edges, "x int, y int")), "node", "label"))
    assert got == {x: find(x) for x in up}
    assert graph.components(spark.createDataFrame([], "x int, y int")).count() == 0


def test_descendants(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    got = graph.descendants(e, spark.createDataFrame([("a",)], "node string"))
    assert set(values(got, "node", "depth")) == {("a", 0), ("b", 1), ("c", 2)}


def test_best_carried_and_collisions(spark):
    d = spark.createDataFrame([(1, "a", "x", 2), (2, "a", None, None), (3, "a", None, None), (4, "b", None, None)], "n int, k string, v string, s int")
    assert sorted(values(records.best_per_key(d, ["k"], [F.desc("n")]), "k", "n")) == [("a", 3), ("b", 4)]
    assert dict(values(records.carried(d, ["k"], [F.col("n")], "v", "s"), "n", "v_carried")) == {1: "x", 2: "x", 3: None, 4: None}
    assert dict(values(records.carried(d, ["k"], [F.col("n")], "v"), "n", "v_carried")) == {1: "x", 2: "x", 3: "x", 4: None}
    c = records.collision_suffix(d, ["k"], F.col("k"), F.col("n").cast("string"), "key")
    assert dict(values(c, "n", "key")) == {1: "a+1", 2: "a+2", 3: "a+3", 4: "b"}


def test_unique_slugs_skip_taken_bases(spark):
    d = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", False), (4, "a-2", False), (5, "b", False)], "n int, base string, sure boolean")
    got = dict(values(records.unique_slugs(d, "base", ["n"], "sure"), "n", "slug"))
    assert got == {2: "a", 1: "a-3", 3: "a-4", 4: "a-2", 5: "b"} and len(set(got.values())) == 5


def test_overrides(spark):
    d = spark.createDataFrame([("k1", "old", 1), ("k2", "x", 2), ("k2", "y", 3)], "key string, title string, size int")
    rules = spark.createDataFrame([("k1", "title", "new", "other"), ("k1", "size", "1", None), ("k2", "title", "z", None), ("k9", "title", "z", None)], "key string, field string, value string, expect string")
    out, report = records.overridden(d.withColumnRenamed("key", "id"), rules, "id", ["title", "size"])
    rows = {(r["id"], r["title"], r["size"], len(r["overrides_applied"])) for r in out.collect()}
    assert rows == {("k1", "new", 1, 1), ("k2", "x", 2, 0), ("k2", "y", 3, 0)}
    assert {(r["key"], r["field"], r["outcome"], r["mismatch"]) for r in report.collect()} >= {("k1", "title", "changed", True), ("k1", "size", "already", False), ("k9", "title", "missing", False)}


def test_merge_plans(spark):
    old = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("c", "1", True), ("d", "1", False)], "k string, v string, manual boolean")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("e", None)], "k string, v string")
    assert dict(values(records.merge_plan(new, old, "k", ["v"]), "key", "action")) == {"a": "skip", "b": "update", "c": "manual", "d": "keep", "e": "create"}
    again = records.merge_plan(new, new, "k", ["v"])
    assert {r["action"] for r in again.collect()} == {"skip"}
    o = spark.createDataFrame([("a", "x", "confirmed"), ("b", "y", "confirmed"), ("c", "z", "candidate")], "k string, value string, status string")
    n = spark.createDataFrame([("a", "q"), ("d", "w")], "k string, value string")
    assert set(values(records.section_merge(o, n, "k"), "k", "value", "status")) == {("a", "x", "confirmed"), ("b", "y", "stale"), ("d", "w", "candidate")}


def test_prefix_rules(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/b",), ("a/bc",), ("z",)], "p string")
    r = spark.createDataFrame([("a/b",), ("a/*",), ("a/b/c",)], "r string")
    assert dict(values(records.prefix_matches(p, "p", r, "r"), "p", "rule")) == {"a/b/c": "a/b/c", "a/b": "a/b", "a/bc": "a/*"}
    assert records.prefix_matches(p, "p", r.where("false"), "r").count() == 0


def test_links(spark):
    d = spark.createDataFrame([("a/b", "../c/./d.html#x"), ("", "../up"), ("a", "./e")], "base string, href string")
    assert [r[0] for r in d.select(links.resolved_path(F.col("base"), F.col("href"))).collect()] == ["a/c/d.html", None, "a/e"]
    inv = spark.createDataFrame([("x/index.html",), ("y.html",), ("z.htm",), ("Q/q.html",)], "path string")
    t = spark.createDataFrame([("x",), ("x/",), ("y",), ("z.html",), ("y.html",), ("no",)], "t string")
    assert dict(values(links.resolve(t, "t", inv, "path"), "t", "found")) == {"x": "x/index.html", "x/": "x/index.html", "y": "y.html", "z.html": None, "y.html": "y.html", "no": None}
    assert dict(values(links.repaired(t.where("t in ('z.html', 'no')"), "t", inv, "path"), "target", "fixed")) == {"z.html": "z.htm", "no": None}
    u = spark.createDataFrame([("h", "/a/b/c"), ("h", "/q"), ("k", "/a")], "host string, rest string")
    tab = spark.createDataFrame([("h", "/a", "one"), ("h", "/a/b", "two"), ("h", None, "top")], "host string, prefix string, place string")
    assert dict(values(links.longest_host(u, "host", "rest", tab), "rest", "place")) == {"/a/b/c": "two", "/q": "top", "/a": None}


def test_text_functions(spark):
    assert one(spark, "<b>a</b> &amp; b<br>c", lambda c: text.cell_text(c, True)) == "a & b\nc"
    assert one(spark, "<b></b>", text.cell_text) is None
    assert one(spark, "mail a.b@site.org or x@example.com or see index@0820.html", text.redacted) == "mail [address] or x@example.com or see index@0820.html"
    assert one(spark, "no address", text.has_leak) is False and one(spark, "MAILTO:x", text.has_leak) is True
    assert one(spark, "硝子へ手紙 第2話", text.title_core) == "硝子へ手紙" and one(spark, "第3話", text.title_core) == "第3話"
    assert one(spark, "【あらすじ】 ab 【感想】cd【あらすじ】ef", lambda c: text.sections(c, ["あらすじ"])) == {"あらすじ": "ab"}
    assert one(spark, "ＡＢＣ　ﾊ", text.nfkc) == "ABC ハ" and one(spark, " Straße　x", text.norm_name) == "strassex"
    assert one(spark, "a　b  c", text.split_tokens) == ["a", "b", "c"] and one(spark, "Hello, World!", text.slugify) == "hello-world"


def test_url_functions(spark):
    assert one(spark, "a/a/b", urls.dedup_segments) == "a/b" and one(spark, "ab/b", urls.dedup_segments) == "ab/b"
    assert one(spark, "www2.Sub.example.org:80", urls.surt_host) == "org,example,sub"
    assert one(spark, "x/y/z.html", urls.ancestors) == ["x/y", "x"] and one(spark, "z", urls.ancestors) == []
    assert tuple(one(spark, "./a/b.html#", urls.split_href)) == ("a/b.html", None, "local")
    assert tuple(one(spark, "http://h/p#q", urls.split_href)) == ("external/h/p", "q", "external")
    assert one(spark, "a b/ü", urls.url_path) == "a%20b/%C3%BC"
    q = lambda v: lambda c: urls.mangled(F.lit("f"), c, v)
    assert [one(spark, "a/b?c", q(v)) for v in ("keep", "flat", "slash", "html", "bare")] == ["f@a/b?c", "f@a_b_c", "f@a_b?c", "f@a_b_c.html", "a/b?c"]


def test_markup(spark):
    page = "<html><body><script>x</script><!-- c --><p>a < b</p><img src='i.gif'><a href=\"k.html\">l</a></body></html>"
    assert one(spark, page, markup.links) == ["i.gif", "k.html"]
    assert one(spark, page, lambda c: markup.proof(markup.body_of(c), markup.converted(markup.body_of(c)))) == "equal"
    assert one(spark, "<p>ab</p>", lambda c: markup.proof(c, F.lit("b"))) == "contained" and one(spark, "ab", lambda c: markup.proof(c, F.lit("q"))) == "lost"


def test_charsets():
    s = "日本語の本文です。かなとカナ"
    for enc in ("utf-8", "cp932", "euc_jp"):
        assert guess(s.encode(enc))[0] == s
    assert guess(s.encode("cp932")[:-1])[1] == "cp932-replace" and guess(b"") == ("", "utf-8")
    assert guess(b'<meta charset="Shift_JIS">' + s.encode("cp932"), "meta")[1] == "cp932"


def test_parsers(spark):
    log = spark.createDataFrame([(1, "__C__h1|100|first|x"), (2, "a"), (3, ""), (4, "__C__h2|90|second"), (5, "a"), (6, "b")], "n int, value string")
    got = parsers.first_commits(parsers.commit_log(log, "value", "n"))
    assert set(values(got, "path", "commit")) == {("a", "h2"), ("b", "h2")}
    page = spark.createDataFrame([(1, "<table><tr><td rowspan=2>A<td>x<tr><td>y</table><h2>H</h2>p<br>q")], "k int, h string")
    assert [(r["cells"], r["span"]) for r in parsers.table_rows(page, "k", "h").orderBy("n").collect()] == [(["A", "x"], 2), (["y"], None)]
    assert [r["heading"] for r in parsers.headed_lines(page, "k", "h").where("line in ('p', 'q')").collect()] == ["H", "H"]
    assert tuple(one(spark, "12 KB / 3 FILES", parsers.sizes)) == (12, 3)
    assert one(spark, "作・甲 / 画・乙、丙 (x)", parsers.credits).asDict() == {"author": "甲", "illustrators": ["乙", "丙"]}
    r = spark.range(1).select(parsers.resolved_year(F.lit(12), F.lit(5), F.lit("2000-11-01").cast("date"), F.lit("2001-02-01").cast("date")).alias("r")).collect()[0]["r"]
    assert (str(r["date"]), r["precision"]) == ("2000-12-05", "range-derived")


def test_versions(spark):
    d = spark.createDataFrame([(1, "g", "abc def"), (2, "g", "abc def"), (3, "g", "abc  <b>def</b>"), (4, "g", "zzz"), (5, "h", None)], "k int, g string, t string")
    got = versions.compared_versions(d, ["g"], [F.col("k")], "k", "t")
    assert {(r["k"], r["step"], r["verdict"]) for r in got.collect()} == {(2, "bytes", "same"), (3, "text", "same"), (4, "similar", "distinct")}
    f = spark.createDataFrame([("w", 1, "abc"), ("w", 2, "xyz"), ("w", 3, "abd"), ("w", 4, "a"), ("w", 5, None)], "w string, o int, c string")
    assert dict(values(versions.families(f, "w", "o", "c"), "o", "family")) == {1: 0, 2: 1, 3: 0, 4: 2, 5: 3}


def test_versions_of_all_kinds(spark, tmp_path):
    from corpusloom.plans import derived

    body = "".join(chr(0x4E00 + i * 7 % 997) for i in range(5000))
    rows = [(1, "body", "e", body), (2, "body", "e", body[:2500] + "x" + body[2500:]), (3, "comment", "e", "ab"), (4, "comment", "e", "ab"), (5, "arasuji", "e", body), (6, "body", None, body), (7, "body", "e", None), (8, "body", "f", body)]
    spark.createDataFrame(rows, "doc_id long, kind string, episode_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = derived.txt14_versions(spark, str(tmp_path))
    # versions are of one kind and episode; bodies are compared whole
    assert {tuple(r) for r in got.collect()} == {(2, 1, "similar", 0.9999, "same"), (4, 3, "bytes", 1.0, "same")}


def test_works_of_one_author(spark, tmp_path):
    from corpusloom.plans import catalogue

    rows = [
        (1, "a", "n/d/moon01.html", "窓の夜（1）", "甲", None), (2, "b", "n/d/moon02.html", "別の題", "甲", None), (3, "b", "n/d/moon02.html", None, None, None),  # file stem; a line sent again
        (4, "c", "n/d/moon03.html", "他人の話", "乙", None),  # the same stem by another
        (5, "d", "n/e/x.html", "長い題名 その一", "甲の二", "board"), (6, "e", "n/f/y.html", "長い題名（2）", "甲", "board"), (7, "f", "n/g/z.html", "長い題名", "乙", None),  # title core, author by board
        (8, "g", "n/h/01.html", "短い題", "甲", None), (9, "h", "n/h/02.html", "短い題", "甲", None),  # neither stem nor long core
        (10, None, None, "長い題名", None, None),
    ]
    spark.createDataFrame(rows, "entry_no long, episode_id string, source_path string, title string, author string, kansou_slug string").write.parquet(f"{tmp_path}/episodes.parquet")
    spark.createDataFrame([("kou", "甲の筆名", None, "board")], "slug string, display_name string, display_variants array<string>, kansou_slug string").write.parquet(f"{tmp_path}/authors.parquet")
    got = catalogue.grf01_works(spark, str(tmp_path)).collect()
    assert {r["entry_no"]: r["work"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 10} and len(got) == 10
    assert {r["entry_no"]: r["evidence"] for r in got if r["evidence"]} == {1: (w := ["filename-stem", "id", "path"]), 2: w, 3: w, 5: ["title-prefix"], 6: ["title-prefix"]}
    authors = {}
    for r in got:
        authors.setdefault(r["work"], set()).add(r["author"])
    assert all(len(a) == 1 for a in authors.values())


def test_measured(spark):
    d = spark.range(10)
    assert measured(d, 20).count() == 10 and measured(d, 5) is d
