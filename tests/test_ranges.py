import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import records as R


@pytest.fixture
def split(spark):
    """Ranges stay as many as they are, so a key of many rows lies in several."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(rnd):
    some = lambda: rnd.choice("xyz") if rnd.random() < 0.02 else None
    out = [("hot", i, some(), rnd.randint(1, 400)) for i in range(900)] + [(rnd.choice(["a", "b", None]), 1000 + i, some(), 3) for i in range(80)]
    rnd.shuffle(out)
    return out


def test_hot_keys_across_ranges(split):
    data = rows(random.Random(4))
    d = split.createDataFrame(data, "k string, n int, v string, s int")
    ranges = R.in_ranges(d, ["k"], [F.col("n")])
    assert ranges.where("k = 'hot'").select("_part").distinct().count() > 2
    by_key = {}
    for k, n, v, s in sorted(data, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((n, v, s))
    got = {r["n"]: r["at"] for r in R.numbered_within(ranges, ["k"], [F.col("n")], "at").collect()}
    assert got == {n: i + 1 for own in by_key.values() for i, (n, _, _) in enumerate(own)}
    carried, spanned, back = {}, {}, {}
    for own in by_key.values():
        last, at, reach = None, 0, 0
        for i, (n, v, s) in enumerate(own):
            if v is not None:
                last, at, reach = v, i, s
            carried[n], spanned[n] = last, last if last is not None and i - at < reach else None
        later = None
        for n, v, _ in reversed(own):
            later = v if v is not None else later
            back[n] = later
    assert {r["n"]: r["v_carried"] for r in R.carried(d, ["k"], [F.col("n")], "v").collect()} == carried
    assert {r["n"]: r["v_carried"] for r in R.carried(d, ["k"], [F.col("n")], "v", "s").collect()} == spanned
    assert {r["n"]: r["v_filled"] for r in R.filled_back(d, ["k"], [F.col("n")], "v").collect()} == back
    slugs = [r["slug"] for r in R.unique_slugs(d.withColumn("sure", F.lit(False)).where("k is not null"), "k", ["n"], "sure").collect()]
    assert len(set(slugs)) == len(slugs) and "hot-900" in slugs


def test_empty(split):
    d = split.createDataFrame([], "k string, n int, v string")
    assert R.carried(d, ["k"], [F.col("n")], "v").count() == 0 and R.filled_back(d, ["k"], [F.col("n")], "v").count() == 0
