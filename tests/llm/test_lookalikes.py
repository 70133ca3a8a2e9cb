import itertools

from corpusloom.llm import lookalikes as L

SAME = [("novel/a.html", "nοvel∕a․htmⅼ"), ("ガイド1", "ｶﾞｲﾄﾞ１"), ("ガイド1", "ガイド1"), ("é", "é"), ("二人", "ニ人"), ("a b", "a b"), (" a", "a​ "), ("エピソード", "エピソ一ド"), ("神", "神"), ("一", "⼀")]
OTHER = [("カ", "ガ"), ("1", "①"), ("2", "²"), ("Ch1", "ch1"), ("e", "é"), ("part-1", "part_1"), ("章", "竟"), ("ソ", "ゾ"), ("へや", "べや"), ("1", "l"), ("0", "O")]


def auto(*texts):
    counts = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    return L.automaton(L.rules(counts))


def test_same_and_other():
    a = auto(*itertools.chain(*SAME, *OTHER), "カ゚e" * 3)
    assert [p for p in SAME if L.rewritten(p[0], a) != L.rewritten(p[1], a)] == []
    assert [p for p in OTHER if L.rewritten(p[0], a) == L.rewritten(p[1], a)] == []
    for x in itertools.chain(*SAME, *OTHER):
        assert L.rewritten(L.rewritten(x, a), a) == L.rewritten(x, a)
    assert L.rewritten(None, a) is None and L.rewritten(" ​　", a) == "" and L.rewritten("ａ" * 100_000, auto("ａa")) in ("a" * 100_000, "ａ" * 100_000)


def test_representative_is_the_most_frequent():
    assert L.rules({"о": 5, "o": 1})["o"] == "о" and L.rules({"о": 1, "o": 5})["о"] == "o"


ROWS = [(1, "p/a", None), (2, "p/а", None), (3, "p/a", None), (4, "p/a", ""), (5, "p/a ", " "), (6, "P/a", None), (7, None, None), (8, None, "x"), (9, None, "ｘ"), (10, "p/a", "x"), (2, "p/а", None)]


def test_pairs_against_brute_force(spark):
    d = spark.createDataFrame([(*r, 5) for r in ROWS], "n long, path string, anchor string, _look int")
    got = {tuple(r) for r in L.same_looking_pairs(d, "n", ["path", "anchor"]).collect()}
    a = auto(*[x for _, *t in ROWS for x in t if x])
    look = lambda r: tuple(L.rewritten(x, a) for x in r[1:])
    want = {(x[0], y[0]) for x in ROWS for y in ROWS if x[0] < y[0] and look(x) == look(y) and x[1:] != y[1:]}
    assert got == want and (1, 2) in got and (4, 5) in got and (8, 9) in got and (1, 3) not in got and (1, 4) not in got
    assert L.same_looking_pairs(d.where("false"), "n", ["path", "anchor"]).count() == 0


def test_batches_without_any_text(spark):
    import pandas as pd

    a = auto("abc")
    for held in ([None, None], [], [float("nan"), None], [None, "a"]):
        made = L.all_rewritten(pd.Series(held, dtype=object), a)
        assert made.dtype == object and list(made) == [x if isinstance(x, str) else None for x in held]
    assert list(L.all_rewritten(pd.Series([float("nan")] * 2), a)) == [None, None]
    # one partition holds nothing but nulls, another nothing at all
    d = spark.createDataFrame([(i, None) for i in range(50)] + [(60, "p/a"), (61, "p/а")], "n long, path string").repartition(8, "path")
    looks = d.select("n", L.look(d["path"], {"а": "a"}).alias("l")).collect()
    assert {r["l"] for r in looks if r["n"] < 50} == {None} and {r["l"] for r in looks if r["n"] >= 60} == {"p/a"}
    assert {tuple(r) for r in L.same_looking_pairs(d, "n", ["path"]).collect()} == {(60, 61)}


def test_rewriting_runs_until_nothing_changes():
    chain = {chr(0x4E00 + i): chr(0x4E01 + i) for i in range(20)}
    assert L.rewritten(chr(0x4E00), L.automaton(chain)) == chr(0x4E14)


def test_places(spark):
    d = spark.createDataFrame([(*r, 5) for r in ROWS], "n long, path string, anchor string, place int")
    rows = {r["key"]: r["place"] for r in L.places(d, "n", ["path", "anchor"]).collect()}
    assert len(rows) == 10 and rows[1] == rows[2] == rows[3] and rows[4] == rows[5] and len(set(rows.values())) == 6
