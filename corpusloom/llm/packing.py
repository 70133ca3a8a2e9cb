"""Items of varying length in containers of fixed capacity, with little space left.

The histogram of piece lengths is the whole problem: pieces of one length are alike. A configuration linear program
(how often to use each way of filling a container) is solved by multiplicative weights: the dual price of a length
falls as the length gets covered, and a knapsack by dynamic programming over the capacity gives the best-paying
fillings for the prices, one round of the lengths that are behind from one table. The fractional solution never covers
a length more often than it occurs; it is rounded down, and the pieces that are left make the next, smaller program,
until none is left. Every container comes from a filling of a program. All lengths are priced, at every size.

Only the histogram, at most `capacity` counts, reaches the driver; pieces meet their containers in a join by rank
within length, in blocks of ranks, so no length is gathered or searched in one task.

Defined results: an item longer than the capacity is cut into full pieces and a rest, no other is cut; empty and null
texts have no tokens and take no container; ties between items of a length are settled by key; no item is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces numbered by one task at a time, and blocks of ranks of one length at most.
SHARD, BLOCKS = 50_000, 1024
#: A filling is taken at its fractional count if it leaves no more than this share of the container.
WASTE = 0.02
#: Room of a container in the program; longer containers count in units of several tokens, lengths rounded up.
ROOM = 2048


class Knapsack:
    """The dynamic program over a container's room; all arrays go by length."""

    def __init__(self, room: int) -> None:
        self.room = room

    def solve(self, prices: np.ndarray) -> None:
        """Fills the table: the best pay for each room, and the length to take there (0: leave a place empty)."""
        pay, take = np.zeros(self.room + 1), [0] * (self.room + 1)
        for c in range(1, self.room + 1):
            offers = prices[1 : c + 1] + pay[c - 1 :: -1] if c > 1 else prices[1:2] + pay[0]
            j = int(offers.argmax())
            if offers[j] > pay[c - 1] + 1e-12:
                pay[c], take[c] = offers[j], j + 1
            else:
                pay[c] = pay[c - 1]
        self.prices, self.pay, self.take = prices, pay, take

    def filling(self, first: int, counts: np.ndarray, open_: np.ndarray) -> dict[int, int]:
        """{length: how many} that begins with `first` and goes on along the table, within the counts."""
        out, c, take = {first: 1}, self.room - first, self.take
        while c > 0:
            j = take[c]
            if not j:
                c -= 1
                continue
            if not open_[j] or out.get(j, 0) >= counts[j]:
                offers = np.where(open_[1 : c + 1], self.prices[1 : c + 1] + self.pay[c - 1 :: -1] if c > 1 else self.prices[1:2] + self.pay[0], -1.0)
                for x, n in out.items():
                    if x <= c and n >= counts[x]:
                        offers[x - 1] = -1.0
                j = int(offers.argmax()) + 1
                if offers[j - 1] <= 0:
                    break
            out[j] = out.get(j, 0) + 1
            c -= j
        return out


def fractional(counts: np.ndarray, rounds: int, eta: float) -> dict[tuple[tuple[int, int], ...], float]:
    """{filling: how often} for counts by length, a solution of the program that covers no length more often than it occurs."""
    room = len(counts) - 1
    knapsack = Knapsack(room)
    held = counts > 0
    lengths = np.arange(room + 1)
    weights, covered, at_least = lengths / room, np.zeros(room + 1), np.maximum(counts, 1)
    share = float((lengths * counts).sum()) / room / rounds
    open_ = held.copy()
    out: dict[tuple[tuple[int, int], ...], float] = {}
    for r in range(1, rounds + 1):
        lag = r / rounds - covered / at_least
        knapsack.solve(np.where(open_, weights * np.exp(eta * (lag - lag[held].mean())), -1.0))
        left = share
        for x in np.argsort(np.where(held, -lag * weights, np.inf), kind="stable"):
            if left <= 0 or not held[x]:
                break
            need = r / rounds * counts[x] - covered[x]
            if need <= 0:
                continue
            chosen = knapsack.filling(int(x), counts, open_)
            times = min(need / chosen[int(x)], left, *((counts[j] - covered[j]) / n for j, n in chosen.items()))
            if times <= 0:
                continue
            key = tuple(sorted(chosen.items()))
            out[key] = out.get(key, 0.0) + times
            for j, n in key:
                covered[j] += n * times
                open_[j] = covered[j] < 0.999 * counts[j]
            left -= times
    return out


def plan(histogram: dict[int, int], capacity: int, eta: float = 1.0) -> list[tuple[dict[int, int], int]]:
    """[(filling {length: how many}, containers)] that holds every piece of the histogram."""
    unit = -(-capacity // ROOM)
    if unit > 1:
        return _in_units(histogram, capacity, unit, eta)
    full = histogram.get(capacity, 0)
    out: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for x, c in histogram.items():
        counts[x] = c if x != capacity else 0
    while counts.any():
        total = float((np.arange(capacity + 1) * counts).sum()) / capacity
        if total <= 1:
            return [*out, ({int(x): int(counts[x]) for x in counts.nonzero()[0]}, 1)]
        found = fractional(counts, 80 if total > 60 else 6, eta)
        fill = {k: sum(x * n for x, n in k) for k in found}
        used = 0

        def take(k: tuple[tuple[int, int], ...], times: int) -> None:
            nonlocal used
            times = min([times, *(int(counts[x] // n) for x, n in k)])
            if times > 0:
                out.append((dict(k), times))
                used += times
                for x, n in k:
                    counts[x] -= n * times

        # rounded down, full fillings alone while they make a good part of what is left
        for least in ((1 - WASTE) * capacity, 0):
            if used < 0.1 * total:
                for k in sorted(found, key=lambda k: (-found[k], k)):
                    if fill[k] >= least:
                        take(k, int(found[k]))
        if used < 0.1 * total:
            # the rest is all fractions: fillings of the longest pieces are rounded up, at least one of them
            longest = sorted(found, key=lambda k: (-max(x for x, _ in k), -fill[k], -found[k], k))
            for k in longest:
                if fill[k] >= (1 - WASTE) * capacity:
                    take(k, 1)
            if not used:
                take(longest[0], 1)
    return out


def _in_units(histogram: dict[int, int], capacity: int, unit: int, eta: float) -> list[tuple[dict[int, int], int]]:
    """A plan over lengths in units, each of its places given to the real lengths of that many units in turn."""
    room = capacity // unit
    held: dict[int, list[list[int]]] = {}
    # a length that needs a broken last unit goes alone, as one of all units does
    for x in sorted(histogram):
        held.setdefault(min(-(-x // unit), room), []).append([x, histogram[x]])
    out: list[tuple[dict[int, int], int]] = []
    for filling, times in plan({size: sum(c for _, c in rows) for size, rows in held.items()}, room, eta):
        while times > 0:
            # as many containers as go with one real length for each place, else one container of several
            run = min([times, *(held[size][-1][1] // n for size, n in filling.items())])
            real: dict[int, int] = {}
            for size, n in filling.items():
                need = n * max(run, 1)
                while need:
                    x, c = held[size][-1]
                    got = min(c, need)
                    real[x] = real.get(x, 0) + (n if run else got)
                    need -= got
                    held[size][-1][1] -= got
                    if held[size][-1][1] == 0:
                        held[size].pop()
            out.append((real, max(run, 1)))
            times -= max(run, 1)
    return out


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n): one row a piece; only items longer than the capacity have more than one."""
    d = sizes.where(F.col(size) > 0)
    parts = F.ceil(F.col(size) / capacity).cast("int")
    return d.select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"), F.col(size).alias("_size")).select(
        "key", "piece", F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).cast("int").alias("n")
    )


def packed(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n, container): each piece in its container of `capacity`.

    Pieces of a length are numbered without gathering a length in one task: each (length, shard) is numbered by itself
    and offset by the counts of the shards before it. There are as many shards as the data need.
    """
    spark = sizes.sparkSession
    p = pieces(sizes, key, size, capacity)
    histogram = {r["n"]: r["count"] for r in p.groupBy("n").count().collect()}  # at most `capacity` rows
    shards = max(1, -(-sum(histogram.values()) // SHARD))
    p = p.withColumn("_shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("n").orderBy("_shard")
    counts = p.groupBy("n", "_shard").agg(F.count("*").alias("_c"))
    offsets = counts.select(
        "n", "_shard", (F.sum("_c").over(before) - F.col("_c")).alias("_before"), (F.floor(F.sum("_c").over(Window.partitionBy("n")) / BLOCKS) + 1).alias("_size")
    )
    ranked = p.withColumn("_r", F.row_number().over(Window.partitionBy("n", "_shard").orderBy("key", "piece")).cast("long") - 1)
    ranked = ranked.join(offsets, ["n", "_shard"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    # ranges of ranks within a length that one filling uses: rank r of range [a, b) with n a container is in first + (r - a) // n
    used: dict[int, int] = {}
    first, ranges = 0, []
    for filling, times in plan(histogram, capacity):
        for x, n in filling.items():
            a = used.get(x, 0)
            ranges.append((x, histogram[x] // BLOCKS + 1, a, a + n * times, n, first))
            used[x] = a + n * times
        first += times
    rng = spark.createDataFrame(ranges, "n int, _size long, _a long, _b long, _each long, _first long")
    # a range lies in each block of ranks that it touches; a piece meets the ranges of its own block only
    blocks = rng.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / F.col("_size")), F.floor((F.col("_b") - 1) / F.col("_size"))))).drop("_size")
    placed = ranked.withColumn("_block", F.floor(F.col("_rank") / F.col("_size"))).join(blocks, ["n", "_block"]).where("_a <= _rank and _rank < _b")
    return placed.select(F.col("key").alias(key), "piece", "n", (F.col("_first") + F.floor((F.col("_rank") - F.col("_a")) / F.col("_each"))).cast("long").alias("container"))
