import random

from corpusloom.llm.automata import Trie
from corpusloom.llm.names import bound, distance, index_keys, probe_keys


def osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def word(rnd, n=7):
    return "".join(rnd.choice("abc") for _ in range(rnd.randrange(n)))


def test_within_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        entries = {word(rnd) for _ in range(20)}
        trie = Trie((w, w) for w in entries)
        q = word(rnd)
        for k in (0, 1, 2):
            assert {(w, d) for w, _, d in trie.within(q, k)} == {(w, osa(w, q)) for w in entries if osa(w, q) <= k}
    assert Trie().within("a", 2) == [] and Trie([("a", 1)]).exact("b") == []


def test_scan_meets_every_entry_with_one_edit():
    trie = Trie([("abcdef", "x"), ("ab", "y")])
    rule = lambda n: 1 if n >= 4 else 0
    hit = lambda t: {(v, e) for _, _, v, e in trie.scan(t, rule)}
    assert ("x", 0) in hit("__abcdef__") and ("x", 1) in hit("_abXdef_") and ("x", 1) in hit("abcef") and ("x", 1) in hit("Zbcdef") and ("x", 1) in hit("abcXdef")
    assert not any(v == "x" for v, _ in hit("aXcdXf")) and hit("") == set() and ("y", 0) in hit("zab")


def test_pigeonhole_join_loses_nothing():
    rnd = random.Random(2)
    for _ in range(3000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(5, 16)))
        b = list(a)
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(b))
            kind = rnd.randrange(3)
            if kind == 0:
                b[at] = rnd.choice("abcd")
            elif kind == 1:
                b.insert(at, rnd.choice("abcd"))
            elif len(b) > 1:
                del b[at]
        b = "".join(b)
        k = bound(len(a))
        lev = min(distance(a, b, 2), 3)
        if a != b and lev <= k and bound(len(b)) and osa(a, b) == lev and plain(a, b) <= k:
            assert set(index_keys(a)) & set(probe_keys(b)), (a, b)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rnd = random.Random(4)
    for _ in range(500):
        a, b = word(rnd, 10), word(rnd, 10)
        assert distance(a, b, 2) == min(osa(a, b), 3)
