"""Streams of requests: counts per key and window with late rows bounded, and a fixed window that its first hit opens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, key: str, ts: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, window_start, n): rows per key and window; rows later than `late` fall out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def place_in_windows(seconds: list[int], start: int, n: int, length: int) -> tuple[list[int], int, int]:
    """(place of each hit in its window, start and count of the last window) of hits in order, from a window already open."""
    places = []
    for s in seconds:
        if n == 0 or s >= start + length:
            start, n = s, 0
        n += 1
        places.append(n)
    return places, start, n


def limited(stream: DataFrame, key: str, ts: str, most: int = 3, seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """(key, ts, n, allowed): each row's place in the window that the key's first row opened; rows beyond `most` are refused.

    The rows of a key in one trigger are put in order before they are counted, however many Arrow batches hold them.
    A window's state goes when the watermark passes its end, so keys that stay away keep nothing.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (0, 0)
        times = pd.concat([pdf[ts] for pdf in batches]).sort_values(kind="stable")
        places, start, n = place_in_windows([int(t.timestamp()) for t in times], start, n, seconds)
        state.update((start, n))
        state.setTimeoutTimestamp(max((start + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(places), "ts": list(times), "n": places, "allowed": [p <= most for p in places]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"key {kind}, ts timestamp, n long, allowed boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def fixed_windows(df: DataFrame, key: str, ts: str, id_: str, seconds: int = 3600) -> DataFrame:
    """(id, n): the same places for a table at rest.

    A pause as long as a window always opens a new one, so each key falls into stretches that are counted apart.
    """
    s = F.unix_timestamp(F.date_trunc("second", F.col(ts).cast("timestamp")))
    w = Window.partitionBy("_k").orderBy("_s", "_id")
    d = df.select(F.col(key).alias("_k"), s.alias("_s"), F.col(id_).alias("_id"))
    d = d.withColumn("_new", (F.col("_s") - F.lag("_s").over(w) >= seconds).cast("int")).withColumn("_stretch", F.sum(F.coalesce("_new", F.lit(0))).over(w))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_id"], kind="stable")
        return pd.DataFrame({"id": pdf["_id"], "n": place_in_windows(list(pdf["_s"]), 0, 0, seconds)[0]})

    return d.groupBy("_k", "_stretch").applyInPandas(count, f"id {df.schema[id_].dataType.simpleString()}, n long")
