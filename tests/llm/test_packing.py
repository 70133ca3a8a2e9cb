import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import packing as K


def check(histogram, capacity):
    plan = K.plan(histogram, capacity)
    held = Counter()
    for filling, times in plan:
        assert times > 0 and sum(x * n for x, n in filling.items()) <= capacity
        for x, n in filling.items():
            held[x] += n * times
    assert held == Counter(histogram)
    return sum(t for _, t in plan)


def test_plans_hold_everything_and_little_space():
    rnd = random.Random(6)
    for capacity in (10, 100, 512, 8192):
        h = Counter(min(capacity, 1 + int(rnd.expovariate(6 / capacity))) for _ in range(3000))
        lower = -(-sum(x * n for x, n in h.items()) // capacity)
        assert check(dict(h), capacity) <= lower * 1.02 + 1
    assert K.plan({}, 10) == [] and check({10: 5}, 10) == 5 and check({6: 4}, 10) == 4 and check({1: 1}, 512) == 1


def test_small_against_optimum():
    # 7+3, 6+4 and 5+5 fill ten exactly
    assert check({7: 20, 3: 20, 6: 20, 4: 20, 5: 40}, 10) == 60


def test_rows(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 5, 5, 9, 10, 11, 25, 3, 3, 3, 7] * 20)] + [(9999, None)]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("container", F.lit("clash"))
    got = K.packed(d, "doc_id", "n_tokens", 10).collect()
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["n"]
    assert max(fill.values()) <= 10 and set(fill) == set(range(len(fill)))
    whole = Counter()
    for r in got:
        whole[r["doc_id"]] += r["n"]
    assert whole == Counter({i: n for i, n in rows if n})
    assert all(r["piece"] == 0 for r in got if dict(rows)[r["doc_id"]] <= 10)
    assert K.packed(d.where("false"), "doc_id", "n_tokens", 10).count() == 0


def test_more_lengths_than_any_cap_and_broken_units():
    rnd = random.Random(7)
    for capacity in (6146, 5000):
        h = Counter({x: rnd.randint(1, 3) for x in rnd.sample(range(1, capacity + 1), 1500)})
        lower = -(-sum(x * n for x, n in h.items()) // capacity)
        assert check(dict(h), capacity) <= lower * 1.03 + 1
    # no length is left unpriced: each of 600 lengths pairs with its complement
    assert check({x: 1 for x in range(1, 1200) if x != 600}, 1200) <= 605


def test_fractional_solutions_stay_within_the_counts():
    import numpy as np

    rnd = random.Random(8)
    counts = np.bincount([1 + int(rnd.expovariate(6 / 512)) % 511 for _ in range(5000)], minlength=513)
    found = K.fractional(counts, 80, 1.0)
    covered, lengths = np.zeros(513), np.arange(513)
    for k, times in found.items():
        assert sum(x * n for x, n in k) <= 512
        for x, n in k:
            covered[x] += n * times
    assert (covered <= counts + 1e-6).all() and (covered * lengths).sum() >= 0.9 * (counts * lengths).sum()


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 50)
    monkeypatch.setattr(K, "BLOCKS", 3)
    rnd = random.Random(9)
    d = spark.createDataFrame([(i, 512 if i % 3 == 0 else rnd.randint(1, 60)) for i in range(900)], "doc_id long, n_tokens int")
    got = K.packed(d, "doc_id", "n_tokens", 512).collect()
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["n"]
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got) == 900 and max(fill.values()) <= 512 and set(fill) == set(range(len(fill)))
