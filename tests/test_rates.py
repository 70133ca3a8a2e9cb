import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.streaming import rates


def test_places():
    assert rates.place_in_windows([0, 10, 3599, 3600, 3601, 9000], 0, 0, 3600) == ([1, 2, 3, 1, 2, 1], 9000, 1)
    assert rates.place_in_windows([100], 50, 2, 3600) == ([3], 50, 3) and rates.place_in_windows([], 5, 1, 60) == ([], 5, 1)


def test_windows_of_a_busy_key(spark):
    # more rows of one key than an Arrow batch holds, out of order
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        d = spark.range(1500).select(F.lit("k").alias("user"), F.timestamp_seconds(((F.col("id") * 7919) % 1500) * 10 + 864_000).alias("ts"), ((F.col("id") * 7919) % 1500).alias("id"))
        got = {r["id"]: r["n"] for r in rates.fixed_windows(d, "user", "ts", "id").collect()}
        assert got == {i: i % 360 + 1 for i in range(1500)}
        rows = d.select("user", "ts")
        at = f"/tmp/rates-test-{os.getpid()}"
        rows.write.mode("overwrite").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        q = rates.limited(stream, "user", "ts", late="10 days").writeStream.format("memory").queryName("limited_rows").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.table("limited_rows")
        assert out.count() == 1500 and out.where("allowed").count() == 15 and out.agg(F.max("n")).first()[0] == 360
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("length", [1, 40])
def test_chains_of_any_length(spark, length):
    edges = spark.range(length).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    found = graph.descendants(edges.unionByName(spark.createDataFrame([(length, 0)], "parent long, child long")), spark.createDataFrame([(0,)], "node long"))
    assert {r["node"]: r["depth"] for r in found.collect()} == {i: i for i in range(length + 1)}
