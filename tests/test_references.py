import random
from datetime import datetime, timedelta

from corpusloom.operators import references as R

REFS = "field string, owner string, key string, at timestamp_ntz, extra int"
PARENTS = "field string, key string, begins timestamp_ntz, ends timestamp_ntz, owner string"


def brute(refs, parents):
    out = set()
    for f, o, k, at, _ in refs:
        if k is None:
            continue
        own = [(b, e) for pf, pk, b, e, _ in parents if pf == f and pk == k]
        if not own:
            out.add((f, o, k, at, "missing"))
        elif at is None:
            continue
        elif not any(b is not None and b <= at and (e is None or at < e) for b, e in own):
            late = all(b is None or b > at for b, e in own)
            out.add((f, o, k, at, "late" if late else "deleted"))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(7)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rnd.randrange(400), hours=rnd.randrange(24))
    some = lambda x, p: None if rnd.random() < p else x
    keys = [f"k{i}" for i in range(12)] + [""]
    parents = [(rnd.choice("ab"), some(rnd.choice(keys[:9]), 0.05), some(day(), 0.05), some(day(), 0.4), "x") for _ in range(60)]
    refs = [(rnd.choice("ab"), f"o{rnd.randrange(5)}", some(rnd.choice(keys), 0.1), some(day(), 0.05), 1) for _ in range(400)]
    refs += [("a", "o1", "k1", day(), 1)] * 50  # a hot key
    got = R.orphans(spark.createDataFrame(refs, REFS).drop("extra"), spark.createDataFrame(parents, PARENTS))
    assert {tuple(r) for r in got.collect()} == brute(refs, parents) and got.count() == len(brute(refs, parents))


def test_empty_tables(spark):
    none_r, none_p = spark.createDataFrame([], REFS).drop("extra"), spark.createDataFrame([], PARENTS)
    one = spark.createDataFrame([("a", "o", "k", datetime(2024, 1, 1), 1)], REFS).drop("extra")
    assert R.orphans(none_r, none_p).count() == 0
    assert [r["reason"] for r in R.orphans(one, none_p).collect()] == ["missing"]
    assert R.orphan_counts(one, none_p).collect()[0]["orphan_pct"] == 100.0


def test_ends_in_the_far_future(spark):
    day = datetime(2024, 5, 1)
    parents = [("a", "k1", datetime(1000, 1, 1), datetime(9999, 12, 31), "x"), ("a", "k2", datetime(2023, 1, 1), datetime(2024, 1, 1), "x")]
    refs = [("a", "o", "k1", day, 1), ("a", "o", "k2", day, 1)]
    d = R.orphans(spark.createDataFrame(refs, REFS).drop("extra"), spark.createDataFrame(parents, PARENTS))
    assert {tuple(r) for r in d.collect()} == brute(refs, parents) == {("a", "o", "k2", day, "deleted")}
